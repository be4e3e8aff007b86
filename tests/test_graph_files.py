"""Binary graph files as a data source, and indices kept bucketed."""

import os
import tempfile
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.functions import hilbert
from relgraph.operators import generic_join, motifs, prep
from relgraph.operators.mis import _block_end, maximal_independent_set
from relgraph.sources import codecs, graph_files, graphs


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def in_order(x, y):
    """Cells in the order of the curve, by the levels' own squares: any order that keeps squares together will do here."""
    key = [0] * len(x)
    for bit in range(31, -1, -1):
        key = [k << 2 | (int(a) >> bit & 1) << 1 | (int(b) >> bit & 1) for k, a, b in zip(key, x, y, strict=True)]
    order = np.array(sorted(range(len(key)), key=key.__getitem__), int)
    return x[order], y[order]


@pytest.mark.parametrize("seed", range(4))
def test_prefix_encoding(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 1 << 31 if seed % 2 else 3000, (2, 2000))
    if seed == 2:  # a full square of 16 by 16, and all squares of one of 256 by 256
        side = np.arange(256)
        x, y = np.concatenate([np.repeat(side, 256), [1 << 20]]), np.concatenate([np.tile(side, 256), [5]])
    cells = np.array(sorted({*zip(x.tolist(), y.tolist(), strict=True)}))
    x, y = in_order(cells[:, 0], cells[:, 1])
    levels = graph_files.encode_prefixes(x, y)
    assert [a.tolist() for a in graph_files.decode_prefixes(levels)] == [x.tolist(), y.tolist()]
    for level, shift in (("-high32", 16), ("-next16", 8), ("-next08", 4)):
        assert len(levels[level]) == 2 * len({(a >> shift, b >> shift) for a, b in cells.tolist()})
    if seed == 2:
        assert (levels["-next08"][1::2] == 0).sum() == 256 and levels["-next16"][1] == 256
        with pytest.raises(ValueError, match="repeat"):
            graph_files.encode_prefixes(np.zeros(257, int), np.zeros(257, int))
    none = graph_files.encode_prefixes(np.empty(0, int), np.empty(0, int))
    assert [len(v) for v in none.values()] == [0] * 4 and len(graph_files.decode_prefixes(none)[0]) == 0


@pytest.mark.parametrize("layout", ["split", "hilbert", "prefix"])
def test_files_by_many_tasks(spark, tmp_path, monkeypatch, layout):
    """One file with a hub and vertices without edges, cut anywhere; filters; missing data."""
    monkeypatch.setattr(graph_files, "CHUNK", 7)
    rng = random.Random(1)
    pairs = sorted({(5, k) for k in range(120)} | {(rng.randrange(300_000), rng.randrange(300_000)) for _ in range(150)})
    e = graphs.local_edges(spark, pairs)
    if layout == "split":
        (file,) = codecs.write_binary(e, f"file://{tmp_path}/a", 1, split=True)
        heads = np.fromfile(f"{tmp_path}/a/part-0-nodes", "<i4").reshape(-1, 2)
        np.concatenate([[[1, 0]], heads[:3], [[7, 0], [9, 0]], heads[3:], [[11, 0]]]).astype("<i4").tofile(f"{tmp_path}/a/part-0-nodes")
    else:
        (file,) = {"hilbert": graph_files.write_hilbert, "prefix": graph_files.write_prefixes}[layout](e, f"{tmp_path}/a", 1)
    for edges in (1000, 7):
        got = graph_files.read_edges(spark, [file], layout, edges)
        assert rows(got, "src", "dst") == pairs
        assert layout == "prefix" or got.rdd.getNumPartitions() == -(-len(pairs) // edges)
    got = graph_files.read_edges(spark, [file], layout, 11)
    for src, dst, fewer in (((5, 5), None, True), ((6, 69_999), None, layout == "split"), ((131_072, 1 << 30), (0, 65_535), True), (None, (400_000, 1 << 30), layout == "hilbert")):
        kept = graph_files.read_edges(spark, [file], layout, 11, src, dst)
        assert rows(kept, "src", "dst") == [p for p in pairs if (src is None or src[0] <= p[0] <= src[1]) and (dst is None or dst[0] <= p[1] <= dst[1])]
        assert not fewer or layout == "prefix" or kept.rdd.getNumPartitions() < got.rdd.getNumPartitions()
    body = {"split": "-edges", "hilbert": "-lower", "prefix": "-last08"}[layout]
    path = f"{tmp_path}/a/{file.split('/')[-1]}{body}"
    with open(path, "rb+") as f:
        f.truncate(100)
    with pytest.raises(Exception, match="found|do not fit|must be equal"):
        got.collect()


@pytest.mark.parametrize(("chunk", "edges"), [(7, 7), (3, 11), (1, 200), (1 << 20, 1)])
def test_packed_by_many_tasks(spark, tmp_path, monkeypatch, chunk, edges):
    """One packed file with a hub, parallel edges and vertices without edges, cut anywhere and read in stretches of few words."""
    monkeypatch.setattr(graph_files, "CHUNK", chunk)
    rng = random.Random(6)
    pairs = sorted([(5, k) for k in range(120)] + [(5, 3)] * 2 + [(rng.randrange(40), rng.randrange(300_000)) for _ in range(60)])
    e = graphs.local_edges(spark, pairs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        (file,) = graph_files.write_packed_files(e, f"file://{tmp_path}/a", 1, edges)
        assert rows(codecs.read_packed(spark, file), "src", "dst") == pairs and rows(codecs.read_packed(spark, f"file://{tmp_path}/a"), "src", "dst") == pairs
        parts = graph_files.write_packed_files(e, f"file://{tmp_path}/b", 3, edges)
        assert rows(graph_files.read_edges(spark, parts, "packed"), "src", "dst") == pairs == rows(codecs.read_packed(spark, parts), "src", "dst")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = np.fromfile(f"{tmp_path}/a/part-0", "<i4")
    np.concatenate([[1000, 0], whole, [1001, 0, 1002, 0]]).astype("<i4").tofile(f"{tmp_path}/a/part-0")
    graph_files.index_packed(spark, [file], edges)
    got = graph_files.read_edges(spark, [file], "packed")
    assert rows(got, "src", "dst") == pairs and got.rdd.getNumPartitions() == -(-len(pairs) // edges)
    kept = graph_files.read_edges(spark, [file], "packed", src=(30, 33), dst=(0, 200_000))
    assert rows(kept, "src", "dst") == [p for p in pairs if 30 <= p[0] <= 33 and p[1] <= 200_000]
    assert edges > len(pairs) // 2 or kept.rdd.getNumPartitions() < got.rdd.getNumPartitions()
    assert graph_files.read_edges(spark, graph_files.write_packed_files(e.limit(0), f"{tmp_path}/c", 2), "packed").isEmpty()
    with open(f"{tmp_path}/a/part-0", "rb+") as f:
        f.truncate(400)  # within the hub
    with pytest.raises(Exception, match="cut off|found"):
        got.collect()
    with pytest.raises(Exception, match="cut off"):
        graph_files.index_packed(spark, [file], edges)


def test_files_along_the_curve(spark, tmp_path):
    """Parts follow one another along the curve; no edges, no files."""
    rng = random.Random(2)
    e = graphs.local_edges(spark, [(rng.randrange(1 << 20), rng.randrange(1 << 20)) for _ in range(500)])
    files = graph_files.write_hilbert(e, f"{tmp_path}/a", 3)
    spans = [hilbert.with_key(graph_files.read_edges(spark, [f], "hilbert")).agg(F.min("hilbert_key"), F.max("hilbert_key")).first() for f in files]
    assert len(files) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert graph_files.write_prefixes(e.limit(0), f"{tmp_path}/b", 3) == [] and graph_files.read_edges(spark, [], "hilbert").collect() == []


def test_bucketed_index(spark, tmp_path):
    """The index side of a join needs no exchange."""
    e = prep.normalize(graphs.local_edges(spark, [(a, b) for a in range(40) for b in range(40) if (a * b) % 3 == 1])).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index = generic_join.keep_bucketed(generic_join.build_index(e, "src", "dst"), "kept_index", str(tmp_path), 4)
        joined = generic_join.index_join(graphs.local_edges(spark, [(1, 2), (2, 4)]), index, "dst")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert rows(motifs.triangles(e, index, expand=True), *"abc") == rows(motifs.triangles(e, expand=True), *"abc")
        assert rows(index.sizes, "key", "n") == rows(e.groupBy("src").count(), "src", "count")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()


def greedy(pairs):
    near = {v: set() for p in pairs for v in p}
    for s, t in pairs:
        if s != t:
            near[s].add(t)
            near[t].add(s)
    taken = set()
    for v in sorted(near):
        if not near[v] & taken:
            taken.add(v)
    return sorted(taken)


def test_independent_set_of_a_squared_path(spark):
    """Every vertex waits for the two before it: 10 000 of them, in blocks of a few thousand edges."""
    n = 10_000
    pairs = [(k, k + 1) for k in range(n - 1)] + [(k, k + 2) for k in range(n - 2)]
    e = graphs.local_edges(spark, pairs)
    assert rows(maximal_independent_set(e, plain=1, block_edges=15_000), "v") == [(k,) for k in range(0, n, 3)]


def test_independent_set_blocks(spark):
    rng = random.Random(4)
    pairs = [(k, k + d) for k in range(300) for d in (1, 2, 3)] + [(10**12 + rng.randrange(200), rng.randrange(300)) for _ in range(300)]
    e = graphs.local_edges(spark, pairs)
    assert rows(maximal_independent_set(e, plain=0, block_edges=400), "v") == [(v,) for v in greedy(pairs)]
    work = spark.createDataFrame([(10**12, 1), (5, 2), (5, None), (6, None)], "v long, u long")
    ends = [_block_end(work, k) for k in (1, 2, 3, 10)]
    assert ends[:2] == [None, 5] and 6 <= ends[2] < 10**12 <= ends[3]


def test_split_parts(spark, tmp_path):
    """Each part's files have its own degrees; a vertex's edges may reach over batches."""
    e = graphs.local_edges(spark, [(a, b) for a in (1, 2, 3) for b in range(30)] + [(9, 4)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        files = graph_files.write_split_parts(e, f"{tmp_path}/a", (F.col("dst") % 3 - 1) * 5, 2)
        assert sorted(files) == [-5, 0, 5] and rows(codecs.read_split(spark, list(files.values())), "src", "dst") == rows(e, "src", "dst")
        assert rows(codecs.read_split_degrees(spark, [files[0]]), "v", "degree") == [(1, 10), (2, 10), (3, 10), (9, 1)]
        assert graph_files.write_split_parts(e.limit(0), f"{tmp_path}/b", F.col("dst"), 2) == {}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parts_are_sorted_by_many_tasks_and_read_in_stretches(spark, tmp_path, monkeypatch):
    """A hub's edges lie over several tasks' stretches of one part, and the files come out whole."""
    e = spark.createDataFrame([(4, k) for k in range(400)] + [(8 * k, k + 1) for k in range(2, 90)] + [(3, 1), (3, 2)], "src long, dst long")
    want = sorted(map(tuple, e.collect()))
    tasks = []
    segments = graph_files._segments
    monkeypatch.setattr(graph_files, "_segments", lambda *a: tasks.append(found := segments(*a)) or found)
    packed = codecs.write_binary(e, f"file://{tmp_path}/p", 4)
    split = codecs.write_binary(e, f"file://{tmp_path}/s", 4, split=True)
    assert all(len(t[0]) > 2 and len({r.first for r in t[0]}) < len(t[0]) for t in tasks)
    assert sorted(map(tuple, codecs.read_packed(spark, packed).collect())) == sorted(map(tuple, codecs.read_split(spark, split).collect())) == want
    lists = codecs.read_packed_lists(spark, packed).collect()
    assert sorted((r.key, v) for r in lists for v in r.vs) == want and len(lists) == len({a for a, _ in want})
    assert sorted(map(tuple, codecs.read_split_degrees(spark, split).collect())) == sorted((a, sum(x == a for x, _ in want)) for a in {a for a, _ in want})
    assert not [f for f in (tmp_path / "p").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_prefix_files_in_stretches(spark, tmp_path, monkeypatch):
    """Levels are written and read some blocks at a time: as when they are encoded at once."""
    monkeypatch.setattr(graph_files, "CHUNK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    cells = sorted({(x * 31 % 700 + (x % 3 << 16), x * 17 % 500) for x in range(900)} | {(x, y) for x in range(16) for y in range(16)})
    files = graph_files.write_prefixes(spark.createDataFrame(cells, "src long, dst long"), f"file://{tmp_path}/x", 1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(graph_files, "decode_prefixes", None)  # which needs whole levels
    got = list(graph_files.read_prefixes(files[0]))
    x, y = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(2))
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == cells and max(map(len, got)) <= 64
    for level, data in graph_files.encode_prefixes(x, y).items():
        assert graph_files._open(files[0] + level).read() == data.tobytes()


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_files_along_the_curve_hold_wide_ids(spark, monkeypatch, chunk):
    """ids beyond 31 and 32 bits, in one file and in several; ids of 32 bits make the files they did."""
    monkeypatch.setattr(graph_files, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 10, (300, 2))
    far = {"hilbert": 47, "prefix": 62}
    with tempfile.TemporaryDirectory() as to:
        for layout, bits in far.items():
            cells = np.concatenate([near, near + [1 << 31, 5], near + [1 << 32, 1 << 33], near + [7 << 40, 0], rng.integers(0, 1 << bits, (50, 2))])
            want = sorted({tuple(x) for x in cells.tolist()})
            e = spark.createDataFrame(want, "src long, dst long")
            for parts in (1, 3):
                write = graph_files.write_hilbert if layout == "hilbert" else graph_files.write_prefixes
                files = write(e, f"{to}/{layout}{parts}", parts)
                assert sorted(tuple(r) for r in graph_files.read_edges(spark, files, layout).collect()) == want
                if layout == "hilbert":
                    own = graph_files.read_edges(spark, files, layout, edges=20, src=(1 << 31, 1 << 46), dst=(0, 1 << 34))
                    assert sorted(tuple(r) for r in own.collect()) == [p for p in want if 1 << 31 <= p[0] <= 1 << 46 and p[1] <= 1 << 34]
                elif parts == 1:
                    found = {r.level: r.records for r in graph_files.prefix_records(spark, files).collect()}
                    assert found == {level: len({(x >> low, y >> low) for x, y in want}) for level, low in (("high32", 16), ("next16", 8), ("next08", 4), ("last08", 0))}
            files = write(spark.createDataFrame(near.tolist(), "src long, dst long"), f"{to}/{layout}-near", 1)
            assert not [f for f in os.listdir(f"{to}/{layout}-near") if f.endswith("-pages")] and len(files) == 1
            with pytest.raises(Exception, match="ids must be from 0"):
                write(spark.createDataFrame([(-1, 3)], "src long, dst long"), f"{to}/{layout}-bad", 1)
