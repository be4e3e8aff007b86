"""Goldens and properties on small graphs, and every registered query against its SQL on the smallest tables."""

import itertools
import random
import subprocess
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.functions import hilbert
from relgraph.operators import bitmaps, components, cubes, generic_join, motifs, pagerank, prep
from relgraph.operators.iterate import iterate, until
from relgraph.operators.mis import maximal_independent_set
from relgraph.plans import catalog
from relgraph.sources import codecs, graphs

SF = "/root/testdata/sf0.001"
K5 = list(itertools.combinations(range(5), 2))
C4A, C4B = [(0, 1), (0, 2), (1, 3), (2, 3)], [(0, 1), (1, 2), (2, 3), (3, 0)]
DIRTY = [(1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (1, 2), (5, 6), (7, 7), (3, 4)]


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(("pairs", "triangles", "rect", "rect_sym", "flags", "cliques", "work"), [(K5, 10, 10, 120, 5, 5, 16), (C4A, 0, 2, 8, 0, 0, 4), (C4B, 0, 0, 8, 0, 0, 4), (DIRTY, 1, 0, 0, 0, 0, 5)])
def test_motif_goldens(spark, pairs, triangles, rect, rect_sym, flags, cliques, work):
    e = prep.normalize(graphs.local_edges(spark, pairs)).cache()
    counts = motifs.triangle_count(e).select("triangles").unionAll(motifs.triangle_count(prep.orient_by_degree(e)))
    counts = counts.unionAll(motifs.factor_count(motifs.rectangles(e), "d", "n")).unionAll(motifs.rectangles(prep.symmetrize(e), expand=True).groupBy().count())
    counts = counts.unionAll(motifs.factor_count(motifs.flags(e), "d", "n")).unionAll(motifs.cliques(e, 4).groupBy().count()).unionAll(prep.assess_work(e))
    assert [r[0] for r in counts.collect()] == [triangles, triangles, rect, rect_sym, flags, cliques, work]
    spark.catalog.clearCache()


def test_generic_join_forms_agree(spark):
    rng = random.Random(3)
    e = prep.normalize(graphs.local_edges(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(300)]))
    pre = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = []
    for form, width in (("auto", 1 << 20), ("rows", 1 << 20), ("auto", 0), ("auto", 6)):
        index = generic_join.build_index(e, "src", "dst", max_width=width)
        found.append(rows(generic_join.extend(pre, [generic_join.Atom(index, "a"), generic_join.Atom(index, "b")], "c", form=form), "a", "b", "c"))
        assert (index.heavy is None) == (width > 40) and index.lists.filter(F.col("n") > width).isEmpty() and rows(index.sizes, "key", "n") == rows(e.groupBy("src").count(), "src", "count")
    assert found[0] == found[1] == found[2] == found[3]
    have = set(rows(e, "src", "dst"))
    want = [c for c in itertools.combinations(range(40), 4) if all(p in have for p in itertools.combinations(c, 2))]
    assert rows(motifs.cliques(e, 4), *"abcd") == rows(motifs.cliques(e, 4, form="rows"), *"abcd") == rows(bitmaps.cliques(e, 4), *"abcd") == want


@pytest.mark.parametrize("sides", [(1, 1, 2, 2), (2, 3, 2, 4), (8, 6, 10, 12)])
def test_extension_within_a_class(spark, monkeypatch, sides):
    for name, bits in zip(("RUN", "TIMES", "CELL_VALUES", "CELL_PREFIXES"), sides, strict=True):
        monkeypatch.setattr(generic_join, name, bits)
    rng = random.Random(5)
    pairs = [(rng.randrange(-60, 60), rng.randrange(9)) for _ in range(150)] * 2 + [(None, 1)]  # copies of a prefix stay
    held = sorted({rng.randrange(-70, 70) for _ in range(80)})
    prefixes = spark.createDataFrame([(y, x) for x, y in pairs], "y long, x long")
    values = spark.createDataFrame([(v,) for v in held] + [(None,)], "v long")
    found = generic_join.extend_alike(prefixes, "x", values, lambda c: F.pmod(c, F.lit(3)), "d")
    assert found.columns == ["y", "x", "d"]
    assert rows(found, "x", "y", "d") == sorted((x, y, v) for x, y in pairs if x is not None for v in held if v < x and v % 3 == x % 3)
    assert generic_join.extend_alike(prefixes, "x", values.limit(0), lambda c: c % 3, "d").isEmpty()
    spark.catalog.clearCache()


def test_extension_within_a_class_is_written_small(spark, monkeypatch, tmp_path, n=3000):
    """A class's result is quadratic, but neighbouring rows are alike and cost a file little, and many tasks share the class."""
    own = graphs.local_edges(spark, [(97 * i, 97 * i + 1) for i in range(n)])
    monkeypatch.setattr(graphs, "copart_s", lambda spark, sf_dir: own)
    catalog.QUERIES["empty_key_extend"](spark, SF).write.parquet(str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out"))
    want = n * (n - 1) // 2
    assert kept.agg(F.count("*"), F.sum("d"), F.sum("src"), F.sum("dst")).first()[:] == (want, 97 * sum(i * (n - 1 - i) for i in range(n)), (a := 97 * sum(i * i for i in range(n))), a + want)
    files = [p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")]
    assert sum(files) < want / 2 and len(files) > 2, (sum(files), want, len(files))
    spark.catalog.clearCache()


def test_hub_wider_than_a_row(spark, monkeypatch, width=50):
    """Keys wider than a row are extended by rows and all others by lists, and all come out the same."""
    e = prep.normalize(graphs.local_edges(spark, [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(1, 59)] + [(k, k + 2) for k in range(1, 50)])).cache()
    found = lambda: [rows(motifs.triangles(e, expand=True), *"abc"), rows(motifs.rectangles(e, expand=True), *"abcd"), rows(motifs.flags(e, expand=True), *"abcd"), rows(motifs.cliques(e, 4), *"abcd"), one(motifs.triangle_count(e))]
    want = found()
    monkeypatch.setattr(generic_join, "MAX_WIDTH", width)
    got = generic_join.build_index(e, "src", "dst")
    assert got.lists.filter(F.col("n") > width).isEmpty() and got.heavy_sizes.count() == 1
    assert found() == want and all(want)
    spark.catalog.clearCache()


def test_heavy_plans_are_linear(spark, monkeypatch):
    """A hub among the keys, by rows and lists: a further level adds to the plan what the one before did."""
    e = prep.normalize(graphs.local_edges(spark, [(0, k) for k in range(1, 30)] + list(itertools.combinations(range(1, 8), 2)))).cache()
    want = list(itertools.combinations(range(8), 5))
    monkeypatch.setattr(generic_join, "MAX_WIDTH", 20)
    lines = []
    for k in (3, 4, 5):
        found = motifs.cliques(e, k)
        lines.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert rows(found, *"abcde") == want and lines[2] - lines[1] < 1.5 * (lines[1] - lines[0])
    spark.catalog.clearCache()


@pytest.mark.parametrize("top", [40, 3000])
def test_bitmaps(spark, top):
    """One block, and many; negative values, duplicates and nulls; the same as by lists."""
    rng = random.Random(top)
    pairs = [(rng.randrange(40), rng.randrange(40) * (top // 40) - 7) for _ in range(400)]
    index = bitmaps.build_bitmaps(spark.createDataFrame([*pairs, pairs[0], (1, None), (None, 1)], "k long, v long"), "k", "v")
    assert rows(bitmaps.expand_bits(index, "v"), "key", "v") == sorted(set(pairs))
    assert one(index.agg(F.sum(bitmaps.counted()))) == len(set(pairs))
    e = prep.normalize(graphs.local_edges(spark, [tuple(rng.choices(range(0, top, top // 40), k=2)) for _ in range(600)])).cache()
    assert one(bitmaps.clique_count(e, 4)) == motifs.cliques(e, 4).count() > 0
    assert rows(bitmaps.cliques(e, 5), *"abcde") == rows(motifs.cliques(e, 5), *"abcde")
    assert one(bitmaps.clique_count(e.limit(0), 4)) == 0
    spark.catalog.clearCache()


def test_computed_relations(spark):
    """A range and a congruence beside an index: whichever proposes, the same values come out."""
    e = graphs.local_edges(spark, [(a, b) for a in range(6) for b in range(0, 60, 1 + a)])
    pre = e.filter("dst % 7 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    index = generic_join.build_index(e, "src", "dst")
    have = rows(e, "src", "dst")
    for width in (1, 40):
        near = generic_join.Between(lambda b, w=width: b - w, lambda b, w=width: b + w)
        atoms = [generic_join.Atom(index, "a"), generic_join.Atom(near, "b"), generic_join.Atom(generic_join.Congruent(3), "b")]
        want = sorted((a, b, c) for a, b in have if b % 7 == 0 for x, c in have if x == a and abs(c - b) <= width and (c - b) % 3 == 0)
        assert rows(generic_join.extend(pre, atoms, "c"), "a", "b", "c") == want == rows(generic_join.extend(pre, atoms[::-1], "c"), "a", "b", "c")
    assert {r.rel for r in generic_join.propose(pre, atoms).collect()} == {0} and {r.rel for r in generic_join.propose(pre, [atoms[0], generic_join.Atom(generic_join.Between(lambda b: b, lambda b: b + 1), "b")]).collect()} == {1}


def test_rectangle_count(spark):
    """Counted by paths of two edges: as many as are listed, on oriented, directed and symmetric edges."""
    rng = random.Random(9)
    e = graphs.local_edges(spark, sorted({p for _ in range(250) if (p := (rng.randrange(25) * 700, rng.randrange(25) * 700))[0] != p[1]})).cache()
    for graph in (e, prep.normalize(e), prep.symmetrize(e)):
        assert one(motifs.rectangle_count(graph)) == motifs.rectangles(graph, expand=True).count() > 0
    spark.catalog.clearCache()


@pytest.mark.parametrize("plain", [0, 6])
def test_independent_set_of_a_long_path(spark, plain):
    n, rng = 10_000, random.Random(5)
    path = graphs.local_edges(spark, [(k, k + 1) for k in range(n - 1)])
    assert rows(maximal_independent_set(path, plain=plain), "v") == [(k,) for k in range(0, n, 2)]
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(700)]
    near = {v: set() for p in pairs for v in p}
    for s, t in pairs:
        if s != t:
            near[s].add(t)
            near[t].add(s)
    taken = set()
    for v in sorted(near):
        if not near[v] & taken:
            taken.add(v)
    assert rows(maximal_independent_set(graphs.local_edges(spark, pairs), plain=plain), "v") == [(v,) for v in sorted(taken)]


@pytest.mark.parametrize("levels", [32, 31, 6, 5])
def test_hilbert_forms_agree(spark, levels):
    rng, top = random.Random(levels), 1 << min(31, levels)
    pairs = [(rng.randrange(top), rng.randrange(top)) for _ in range(300)] + [(0, 0), (top - 1, 0), (0, top - 1), (top - 1, top - 1)]
    e = graphs.local_edges(spark, pairs)
    keyed = hilbert.with_key(e, levels=levels).withColumn("bitwise", hilbert.hilbert_key("src", "dst", levels))
    got = hilbert.with_cell(keyed, levels=levels).collect()
    assert all(r.hilbert_key == r.bitwise and (r.src, r.dst) == (r.x, r.y) for r in got) and len(got) == len(pairs)
    with pytest.raises(Exception, match="2\\^31"):
        hilbert.with_key(graphs.local_edges(spark, [(-1, 5)])).collect()


def test_binary_files(spark, tmp_path):
    """Written, read back by the readers, under paths with and without a scheme; ids that do not fit raise."""
    rng = random.Random(6)
    e = graphs.local_edges(spark, sorted({(rng.randrange(50), rng.randrange(50)) for _ in range(300)}))
    want = rows(e, "src", "dst")
    for k, uri in enumerate((f"{tmp_path}/a", f"file://{tmp_path}/b")):
        packed, split = codecs.write_binary(e, uri, 3), codecs.write_binary(e, f"{uri}-split", 3, split=True)
        assert len(packed) == len(split) == 3 and packed[1] == f"{uri}/part-1"
        assert rows(codecs.read_packed(spark, packed), "src", "dst") == rows(codecs.read_split(spark, split), "src", "dst") == want
        assert [src for src, _ in want if src % 3 == k] == sorted(codecs.decode_packed(Path(tmp_path, "ab"[k], f"part-{k}").read_bytes())[0].tolist())
    assert codecs.write_binary(e.limit(0), f"{tmp_path}/none", 3) == []
    for big in (1 << 31, (1 << 40) + 7):
        for encode in (codecs.encode_packed, codecs.encode_split):
            with pytest.raises(ValueError, match="32 bits"):
                encode(np.array([1]), [np.array([big])])
            with pytest.raises(ValueError, match="32 bits"):
                encode(np.array([big]), [np.array([1])])


def test_unkeyed_atom(spark):
    """Proposes all its values, validates others' values, and proposes only where it has fewest; empty, it allows none."""
    e = graphs.local_edges(spark, [(1, k) for k in range(2, 9)] + [(2, 3), (3, 4), (4, 9)])
    pre = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    few = generic_join.Atom(generic_join.build_unkeyed(e.filter("src in (2, 3, 4)"), "src"), None)
    keyed = generic_join.Atom(generic_join.build_index(e, "src", "dst"), "a")
    have = rows(e, "src", "dst")
    assert rows(generic_join.extend(pre, [few], "c"), "a", "b", "c") == sorted((a, b, c) for a, b in have for c in (2, 3, 4))
    want = sorted((a, b, c) for a, b in have for x, c in have if a == x and c in (2, 3, 4))
    assert rows(generic_join.extend(pre, [keyed, few], "c"), "a", "b", "c") == rows(generic_join.extend(pre, [few, keyed], "c"), "a", "b", "c") == want
    assert {(r.a, r.rel, r.n) for r in generic_join.propose(pre, [keyed, few]).collect()} == {(1, 1, 3), (2, 0, 1), (3, 0, 1), (4, 0, 1)}
    none = generic_join.Atom(generic_join.build_unkeyed(e.limit(0), "src"), None)
    assert generic_join.extend(pre, [none], "c").isEmpty()


def test_tie_rules(spark):
    e = graphs.local_edges(spark, [(2, 1)])
    assert rows(prep.orient_by_degree(e), "src", "dst") == [(1, 2)]
    assert rows(prep.swap_by_degree(e), "src", "dst") == [(2, 1)]
    values = spark.createDataFrame([(1, 5), (2, 5)], "v long, value long")
    assert rows(prep.orient_by_value(e, values), "src", "dst") == [(1, 2)]


def test_chunks_of_a_hub(spark):
    pairs = [(7, k * 3 % 1000) for k in range(1000)] + [(9, 1), (9, 1), (3, 5)]
    got = {(r.src, r.chunk): r for r in prep.adjacency(graphs.local_edges(spark, pairs), chunk=64).collect()}
    assert sorted(got) == [(3, 0)] + [(7, k) for k in range(16)] + [(9, 0)]
    assert [v for k in range(16) for v in got[7, k].neighbours] == list(range(1000))
    assert got[9, 0].neighbours == [1, 1] and got[9, 0].degree == 2 and got[7, 15].degree == 1000
    assert prep.adjacency(graphs.local_edges(spark, []), chunk=64).isEmpty()


def test_following_row(spark):
    values = random.Random(5).sample(range(10_000), 500)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v long").repartition(7)
    got = {r.k: r.next for r in prep.following(rows, "v", "k").collect()}
    assert got == dict(enumerate([*values[1:], None]))


def test_number_is_dense(spark):
    ids = spark.range(0, 1000, 7).select(F.col("id").alias("v"))
    assert rows(prep.number(ids, "v"), "v", "new") == [(7 * k, k) for k in range(143)]


@pytest.mark.parametrize(("variant", "reset", "want"), [("disk", 0.85, [0.85, 0.91375, 4.856687]), ("disk", 0.15, [0.15, 0.21375, 5.004563]), ("blocks", 0.85, [0.85, 0.91375, 1.050812]), ("blocks", 0.15, [0.15, 0.21375, 0.395438])])
def test_pagerank_chain(spark, variant, reset, want):
    got = rows(pagerank.pagerank(graphs.local_edges(spark, [(0, 1), (1, 2), (0, 2)]), variant, reset=reset), "v", "rank")
    assert [r for _, r in got] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("most", [7, 64, 1 << 20])
def test_pagerank_blocks_equal_joined(spark, most):
    """A hub, parallel edges, a vertex that only receives; blocks smaller than the hub's edges, and one for all."""
    rng = random.Random(5)
    pairs = [(0, k) for k in range(1, 120)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(900)] + [(5, 6)] * 3 + [(6, 2**31 - 1)]
    e = graphs.local_edges(spark, pairs)
    sizes = [(len(r.at), len(r.to)) for r in pagerank.packed(e, most).collect()]
    assert all(a == b for a, b in sizes) and sorted(a for a, _ in sizes) == sorted([most] * (len(pairs) // most) + ([len(pairs) % most] if len(pairs) % most else []))
    got, want = (dict(rows(f(e, rounds=4, **more), "v", "rank")) for f, more in ((pagerank.blocks, {"most": most}), (pagerank.joined, {})))
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], rel=1e-12) for v in want)
    assert pagerank.blocks(e.limit(0), rounds=2).count() == 0


def test_pagerank_blocks_stay_in_place(spark):
    """A round's plan exchanges ranks and sums; the packed edges come from where they are held."""
    e = graphs.local_edges(spark, [(k, (7 * k) % 50) for k in range(200)])
    ranks = prep.vertices(e).withColumn("value", F.lit(1.0))
    plan = pagerank.block_push(e, 20)(ranks, 0.5)._jdf.queryExecution().executedPlan().toString()
    own = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert "Exchange" not in own[: own.index("InMemoryTableScan")]


def test_pagerank_dataflow(spark):
    got = rows(pagerank.dataflow(graphs.local_edges(spark, [(0, 1), (1, 2), (0, 2)])), "v", "rank")
    assert [r for _, r in got] == pytest.approx([0.15, 0.21375, 0.245438], abs=1e-6)
    got = rows(pagerank.dataflow(graphs.local_edges(spark, [(0, 1), (1, 0), (1, 2)])), "v", "rank")
    assert [r for _, r in got] == pytest.approx([0.334631, 0.434432, 0.184631], abs=1e-6)


def test_components_and_independent_set(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(500 + k, 501 + k) for k in range(40)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((v, root(v)) for v in parent)
    e = graphs.local_edges(spark, pairs)
    assert rows(components.labels(e), "v", "label") == want
    assert rows(components.labels(e, pre_reduce=True), "v", "label") == want
    assert rows(components.propagate(e), "v", "label") == want
    assert one(components.forest_size(e)) == sum(v != r for v, r in want)
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    chosen = set()
    for v in sorted(parent):
        if not near.get(v, set()) & chosen:
            chosen.add(v)
    assert rows(maximal_independent_set(e), "v") == sorted((v,) for v in chosen)


def test_hilbert(spark):
    goldens = {(0, 0): 0, (0, 1): 3, (1, 0): 1, (1, 1): 2, (2, 3): 9, (5, 10): 119, (1999, 99): 1404496, (2147483646, 2147483645): 3074457345618258599}
    e = graphs.local_edges(spark, list(goldens)).withColumn("k", hilbert.hilbert_key("src", "dst")).withColumn("c", hilbert.hilbert_cell("k"))
    for r in e.collect():
        assert r.k == goldens[(r.src, r.dst)] and (r.c.x, r.c.y) == (r.src, r.dst)
    cells = spark.range(64).select(hilbert.hilbert_cell("id").alias("c"), "id").orderBy("id").collect()
    assert len({(r.c.x, r.c.y) for r in cells}) == 64
    assert all(abs(a.c.x - b.c.x) + abs(a.c.y - b.c.y) == 1 for a, b in itertools.pairwise(cells))


def test_codecs(spark, tmp_path):
    src, lists = np.array([1, 4, 9]), [np.array([2, 3]), np.array([], int), np.array([7])]
    (tmp_path / "g.bin").write_bytes(codecs.encode_packed(src, lists))
    want = [(1, 2), (1, 3), (9, 7)]
    assert rows(codecs.read_packed(spark, str(tmp_path / "g.bin")), "src", "dst") == want
    assert codecs.read_packed(spark, str(tmp_path / "g.bin"), limit=2).count() == 2
    nodes, edges = codecs.encode_split(src, lists)
    (tmp_path / "s-nodes").write_bytes(nodes)
    (tmp_path / "s-edges").write_bytes(edges)
    assert rows(codecs.read_split(spark, [str(tmp_path / "s")]), "src", "dst") == want
    for part in (0, 1):  # cumulative offsets: vertices part, part + 2, ...
        (tmp_path / f"p{part}-nodes").write_bytes(np.array([1, 3], "<i4").tobytes())
        (tmp_path / f"p{part}-edges").write_bytes(np.array([5, 6, 8], "<i4").tobytes())
    got = rows(codecs.read_split(spark, [str(tmp_path / "p0"), str(tmp_path / "p1")], cumulative=True), "src", "dst")
    assert got == [(0, 5), (1, 5), (2, 6), (2, 8), (3, 6), (3, 8)]
    (tmp_path / "t.txt").write_text("# c\n1 2\n\n3\t4 x\nbad line\n")
    assert rows(codecs.read_text(spark, str(tmp_path / "t.txt")), "src", "dst") == [(1, 2), (3, 4)]
    assert rows(codecs.read_text(spark, str(tmp_path / "t.txt"), strict=False), "src", "dst") == [(0, 0), (1, 2), (3, 4)]
    (tmp_path / "n.txt").write_text("3 3\n2 3\n\n1\n")
    assert rows(codecs.read_neighbour_lists(spark, str(tmp_path / "n.txt")), "src", "dst") == [(1, 2), (1, 3), (3, 1)]
    with pytest.raises(ValueError):
        codecs.decode_packed(np.array([1, 5, 2], "<i4").tobytes())


def test_skip_first_goes_by_position(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n3 4\n1 2\n5 6\n")
    (tmp_path / "b.txt").write_text("5 6\n1 2\n")
    (tmp_path / "c.txt").write_text("")
    want = [(1, 2), (1, 2), (3, 4), (5, 6)]
    assert rows(codecs.read_text(spark, str(tmp_path), skip_first=True), "src", "dst") == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6")
    try:
        assert rows(codecs.read_text(spark, str(tmp_path), skip_first=True), "src", "dst") == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_iterate_keeps_results(spark):
    s = iterate(spark.range(3), lambda d: d.select((F.col("id") + 1).alias("id")), 9, every=2)
    assert rows(s, "id") == [(9,), (10,), (11,)]


def test_placements_and_conservation(spark):
    e = graphs.local_edges(spark, [(a, b) for a in range(6) for b in range(6)])
    assert prep.unconserved(e, prep.transpose(prep.transpose(e))).isEmpty()
    assert not prep.unconserved(e, e.limit(5)).isEmpty()
    for kind in ("sp", "pp", "op", "hp"):
        assert e.filter(prep.partition_expr(kind) < 0).isEmpty()
    assert rows(prep.rename(e, prep.random_names(e)), "src", "dst") == rows(e, "src", "dst")


def test_numbered_lines(spark, tmp_path):
    """Numbers do not depend on where a file is split."""
    (tmp_path / "n.txt").write_text("5 6\n2 3\n\n1\n4 5 \n3\n")
    (tmp_path / "m.txt").write_text("1 1\n2\n")
    want = [(1, 2), (1, 2), (1, 3), (3, 1), (4, 4), (4, 5), (5, 3)]
    for size in ("128m", "1", "5"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert rows(codecs.read_neighbour_lists(spark, [str(tmp_path / "n.txt"), str(tmp_path / "m.txt")]), "src", "dst") == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    many = "".join(f"line {i}\n" for i in range(25000))
    (tmp_path / "long.txt").write_text(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
    try:
        got = codecs.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert got.filter(F.concat(F.lit("line "), F.col("line")) == F.col("value")).count() == 25000 == got.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_progress_is_told(spark):
    told = []
    iterate(spark.range(3), lambda d: d.select((F.col("id") + 1).alias("id")), 5, every=2, progress=told.append)
    assert told == [2, 4]
    told = []
    least = lambda d: d.select(F.least(F.col("id") + 1, F.lit(4)).cast("long").alias("id"))
    until(spark.range(4), least, lambda d: d.agg(F.sum("id")).first()[0], progress=lambda k, v: told.append((k, v)))
    assert told == [(1, 10), (2, 13), (3, 15), (4, 16), (5, 16)]


@pytest.mark.parametrize("levels", [5, 32])
def test_carried_orientation_agrees(spark, levels):
    rng = random.Random(levels)
    e = graphs.local_edges(spark, [(rng.randrange(1 << min(levels, 31)), rng.randrange(1 << min(levels, 31))) for _ in range(300)])
    both = e.withColumn("a", hilbert.hilbert_key("src", "dst", levels)).withColumn("b", hilbert.hilbert_key_carried("src", "dst", levels))
    assert both.filter("a <> b").isEmpty()
    assert hilbert.without_prefixes(hilbert.with_prefixes(e)).filter("src <> x or dst <> y").isEmpty()


def test_layout_is_scanned_by_either_end(spark, tmp_path):
    pairs = [(a, b) for a in range(40) for b in range(40)]
    hilbert.write_layout(graphs.local_edges(spark, pairs), str(tmp_path / "h"), 4)
    assert rows(hilbert.scan_layout(spark, str(tmp_path / "h"), src=(3, 5)), "src", "dst") == [p for p in pairs if 3 <= p[0] <= 5]
    assert rows(hilbert.scan_layout(spark, str(tmp_path / "h"), dst=(7, 7)), "src", "dst") == [p for p in pairs if p[1] == 7]


def test_merged_forests_keep_components(spark):
    e = graphs.local_edges(spark, [(i, i + 3) for i in range(60)] + [(i, i + 6) for i in range(57)] + [(100, 101), (100, 100)])
    merged = components.merged_forests(e, levels=2, fan=2)
    assert one(components.forest_size(merged, pre_reduce=False)) == one(components.forest_size(e)) == 63 - 3 + 1
    assert components.merged_forests(e.limit(0)).isEmpty()


def test_forest_of_arrays():
    """Against union-find, on graphs that need several rounds: hubs above their leaves, long paths, parallel edges, loops."""
    rng = random.Random(8)
    cases = [[(k, 1000) for k in range(50)] + [(k, 2000) for k in range(40, 90)], [(k, k + 1) for k in range(500)], [(10**15 + (7 * k) % 501, 10**15 + (7 * k + 7) % 501) for k in range(501)], [(3, 3), (4, 4)], []]
    cases += [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((30, 25), (300, 290), (300, 3000))]
    for pairs in cases:
        src, dst = np.array(pairs, np.int64).reshape(-1, 2).T
        kept = components.forest(src, dst).tolist()
        parent = {v: v for p in pairs for v in p}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for k in kept:  # every edge joins two trees
            a, b = root(pairs[k][0]), root(pairs[k][1])
            assert a != b
            parent[a] = b
        assert all(root(a) == root(b) for a, b in pairs)


@pytest.mark.parametrize(("chunk", "most"), [(1, 1 << 20), (10, 25), (1, 1), (1 << 20, 1)])
def test_local_forests_are_bounded(spark, chunk, most):
    """A forest of the bound's size is passed on, and the components stay what they were."""
    rng = random.Random(9)
    e = graphs.local_edges(spark, [(rng.randrange(400), rng.randrange(400)) for _ in range(900)] + [(1000 + k, 1001 + k) for k in range(60)]).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        kept = components.local_forests(e.coalesce(1), chunk, most)
        assert rows(components.labels(prep.vertices(e).select(F.col("v").alias("src"), F.col("v").alias("dst")).unionAll(kept)), "v", "label") == rows(components.labels(e), "v", "label")
        n, size = kept.count(), one(components.forest_size(e, pre_reduce=False))
        assert n == size if most == 1 << 20 else size <= n < 960
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.catalog.clearCache()


def _tables(sf):
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}{'/*' if p.is_dir() else ''}'")
    return c


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(map(repr, got)), sorted(map(repr, want)), strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    clean = lambda r: tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)
    got = [clean(r) for r in df.select(*cols).collect()]
    want = [clean(r) for r in _tables(SF).sql(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall()]
    same(got, want)
    spark.catalog.clearCache()


def test_whole_graph_queries_lose_no_edge(spark):
    edges = graphs.copart(spark, SF).count()
    for name, times in (("graph_symmetrize", 2), ("orient_by_degree", 1), ("swap_by_degree", 1), ("orient_by_value", 1)):
        assert catalog.QUERIES[f"{name}_copart"](spark, SF).count() == times * edges
    spark.catalog.clearCache()


def test_no_local_checkpoint():
    found = subprocess.run(["grep", "-rln", "localCheckpoint(", "relgraph"], cwd=Path(__file__).parent.parent, capture_output=True, text=True).stdout
    assert not found


@pytest.mark.parametrize(("chunk", "pack", "cell"), [(1 << 21, 1 << 20, 3 << 23), (5, 50, 60)])
def test_cells_send_no_list_along_an_edge(spark, monkeypatch, chunk, pack, cell):
    """Triangles, paths and clique counts in cells, of many buckets, small stretches and wide ids too: as by rows, and joined by nothing."""
    for name, value in (("CHUNK", chunk), ("PACK", pack), ("CELL_EDGES", cell)):
        monkeypatch.setattr(cubes, name, value)
    rng = random.Random(chunk)
    pairs = [(rng.randrange(60) * 37 + (1 << 40), rng.randrange(60) * 37 + (1 << 40)) for _ in range(500)]
    e = prep.normalize(graphs.local_edges(spark, [*pairs, *((5, v) for _, v in pairs)])).cache()
    found = motifs.triangles(e, expand=True)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = rows(motifs.triangles(e, expand=True, form="rows"), *"abc")
    index = generic_join.build_index(e, "src", "dst")
    bits = cubes.triangle_bits(index.rows, index.edges())
    assert rows(found, *"abc") == rows(generic_join.expand_values(motifs.triangles(e), "c"), *"abc") == rows(bitmaps.expand_bits(bits, "c"), *"abc") == want
    assert one(motifs.triangle_count(e)) == one(bitmaps.clique_count(e, 3)) == len(want) > 0
    sums = motifs.triangle_sums(e)
    assert rows(sums, *sums.columns) == sorted((*k, len(g), sum(g)) for k, own in itertools.groupby(want, lambda t: t[:2]) for g in [[t[2] for t in own]])
    for k in (4, 5, 6):
        assert one(bitmaps.clique_count(e, k)) == motifs.cliques(e, k, form="rows").count()
    paths = e.alias("x").join(e.alias("y"), F.expr("x.dst = y.src and x.src <> y.dst")).groupBy("x.src", "y.dst").count()
    assert rows(motifs.two_paths(e), "a", "d", "paths") == sorted(tuple(r) for r in paths.collect())
    spark.catalog.clearCache()


def test_unkeyed_beside_an_index_moves_no_values(spark):
    """Narrowed once, so that prefixes meet lists and no row for each value is shuffled."""
    e = graphs.local_edges(spark, [(a, b) for a in range(12) for b in range(a)])
    atoms = [generic_join.Atom(generic_join.build_unkeyed(e, "src"), None), generic_join.Atom(generic_join.build_index(e, "src", "dst"), "b")]
    found = generic_join.extend(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), atoms, "c", expand=False)
    assert "left_semi" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi").split("inmemoryrelation")[0]
    assert sorted((r.a, r.b, c) for r in found.collect() for c in r.c) == [(a, b, c) for a in range(12) for b in range(a) for c in range(1, b)]


def test_bits_are_folded_by_arrays(spark):
    """No higher-order function a row, and nulls stay null."""
    e = spark.createDataFrame([(5, 10), (None, 3)], "src long, dst long").withColumn("k", hilbert.hilbert_key_carried("src", "dst")).withColumn("c", hilbert.hilbert_cell("k"))
    assert "aggregate(" not in e._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.k, r.c.x, r.c.y) for r in e.collect()] == [(119, 5, 10), (None, None, None)]


def test_edge_sort_sorts_no_part_in_one_task(spark):
    """A place in a part comes from numbers, not from a window over the part."""
    plan = catalog.QUERIES["edge_sort"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    spark.catalog.clearCache()


def test_proposals_are_not_validated_by_their_proposer(spark):
    """By rows, two relations cost a semi-join for each relation's proposals, not two."""
    found = motifs.triangles(graphs.local_edges(spark, K5), expand=True, form="rows")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert found.count() == 10


def _small_blocks(monkeypatch):
    for name, value in (("CHUNK", 7), ("PACK", 40), ("CELL_EDGES", 50), ("LEAST_EDGES", 20)):
        monkeypatch.setattr(cubes, name, value)


def _random_pairs(seed, step, low, n=600, ids=50):
    rng = random.Random(seed)
    return [(rng.randrange(ids) * step + low, rng.randrange(ids) * step + low) for _ in range(n)]


def test_an_edge_lies_in_one_block(spark, monkeypatch):
    """What is shuffled and written is each edge once (both ways: twice), however many blocks there are; ids of 63 bits too."""
    _small_blocks(monkeypatch)
    for step, low in ((1, 0), (3, -70), ((1 << 62) // 40, -(1 << 61))):
        e = prep.drop_self_loops(graphs.local_edges(spark, _random_pairs(step, step, low))).cache()
        have = set(rows(e, "src", "dst"))
        layouts = cubes.laid_out(e.select(F.col("src").alias("key"), F.col("dst").alias("value")), "out", "in", "both")
        for layout, want in zip(layouts, (have, {p[::-1] for p in have}, have | {p[::-1] for p in have}), strict=True):
            own = [sorted(zip(*(x.tolist() for x in layout.edges(k)), strict=True)) for k in range(len(layout.files))]
            assert len(own) >= 8 and sum(map(len, own)) == len(want) and {p for o in own for p in o} == want
            assert len({a for o in own for a in {a for a, _ in o}}) == sum(len({a for a, _ in o}) for o in own)
        e.unpersist()


def test_cliques_by_bits_join_nothing(spark, monkeypatch):
    """listed from the triangles of their first vertex, with small blocks and wide ids too; duplicate edges count once."""
    _small_blocks(monkeypatch)
    for step, low in ((1, 0), (911, 1 << 40)):
        e = prep.normalize(graphs.local_edges(spark, _random_pairs(4, step, low, ids=30))).cache()
        found = bitmaps.cliques(e.unionAll(e), 4)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found, *"abcd") == rows(motifs.cliques(e, 4, form="rows"), *"abcd") != []
        e.unpersist()


def test_rectangles_both_ways(spark, monkeypatch):
    """as many as are listed of the symmetric graph, each edge given once, twice or in both directions."""
    _small_blocks(monkeypatch)
    e = prep.drop_self_loops(graphs.local_edges(spark, [*_random_pairs(6, 5, 1 << 34, n=150, ids=20), *((3, (1 << 34) + 5 * k) for k in range(20))])).cache()
    want = motifs.rectangles(prep.symmetrize(e), expand=True).count()
    assert one(motifs.rectangle_count(e, both_ways=True)) == one(motifs.rectangle_count(prep.symmetrize(e).unionAll(e), both_ways=True)) == one(motifs.rectangle_count(prep.symmetrize(e))) == want > 0
    assert one(motifs.rectangle_count(e.unionAll(e))) == motifs.rectangles(e.distinct(), expand=True).count()
    e.unpersist()


def test_orientation_by_blocks(spark, monkeypatch):
    """by degree without a join, a hub too."""
    _small_blocks(monkeypatch)
    e = prep.normalize(graphs.local_edges(spark, [*_random_pairs(8, 1, 0), *((-1, k) for k in range(50))])).cache()
    found = cubes.oriented_by_degree(e.unionAll(e).select(F.col("src").alias("key"), F.col("dst").alias("value")))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "key", "value") == rows(prep.orient_by_degree(e), "src", "dst")
    assert one(motifs.triangle_count(e, by_degree=True)) == one(motifs.triangle_count(e, form="rows")) > 0
    e.unpersist()


def test_triangle_lists_are_whole(spark, monkeypatch):
    """F6, F8, F10: a pair has one row although its candidates come in stretches, and nothing is put together afterwards."""
    _small_blocks(monkeypatch)
    e = prep.normalize(graphs.local_edges(spark, _random_pairs(2, 1, 0))).cache()
    want = rows(motifs.triangles(e, expand=True, form="rows"), *"abc")
    lists, sums, listed = motifs.triangles(e), motifs.triangle_sums(e.unionAll(e)), motifs.triangles(e, expand=True)
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (lists, sums, listed))
    assert sorted((r.a, r.b, list(r.c)) for r in lists.collect()) == [(*k, [t[2] for t in g]) for k, g in itertools.groupby(want, lambda t: t[:2])]
    assert rows(sums, *sums.columns) == [(*k, len(own), sum(own)) for k, g in itertools.groupby(want, lambda t: t[:2]) for own in [[t[2] for t in g]]]
    assert rows(listed, *"abc") == want
    e.unpersist()
