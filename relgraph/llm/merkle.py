"""A Merkle manifest of a dataset by superblocks.

Rows become leaves; the leaves of a source, in the order of their ids, form a tree of fan-out ``fanout``, and the sources'
roots, in the order of the sources, one more tree on top. Indices are bucketed by ``fanout ** levels``: a bucket's nodes meet
in one group, which climbs ``levels`` levels at once, and bucket roots are reduced in the same way until each tree has one
node. Proofs go back down: a bucket's upper proof joins its nodes' lower ones, so a leaf's proof is put together in one group
and only its digest ever moved. A group holds at most ``fanout ** levels`` nodes whatever the source's size.

Indices within a source come from a range sort over (source, id, leaf) and counts for each (partition, source), so no source
is sorted or numbered by one task.

Defined results: nulls in any field are written ``-``; a null source is a source and comes first; null ids come first; rows
with the same id follow by their leaf, fully repeated rows are leaves each; empty texts are ``0:``; a source with one row has
its leaf as root; an empty table gives an empty manifest; columns that are not fields are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.prep import number
from .session import cut, maybe_broadcast, partitions, read

if TYPE_CHECKING:
    import pandas as pd

FANOUT = 3
#: Levels that a group climbs: 2187 nodes at fan-out 3.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows (partition, source) of starts, about 60 bytes each, up to which they are broadcast.
BROADCAST_STARTS = 100_000

NODE = "g long, idx long, n long, digest binary"
PROOF = "lefts array<string>, rights array<string>, subroot string"


def encoded(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else the UTF-8 bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]).cast("binary"), 256))


def combined(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels until one of ``n`` nodes is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def climb(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The tiers over ``nodes``, themselves the first: every ``fanout`` consecutive ones, or what is left, become one."""
    tiers = [nodes]
    for _ in range(levels):
        below = tiers[-1]
        tiers.append([combined("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return tiers


def siblings(tiers: list[list[str]], i: int, fanout: int) -> tuple[list[str], list[str]]:
    """Of node ``i``, level by level: the digests to the left in its run, and those to the right, each as one text."""
    lefts, rights = [], []
    for tier in tiers[:-1]:
        first = i - i % fanout
        lefts.append("".join(tier[first:i]))
        rights.append("".join(tier[i + 1 : first + fanout]))
        i //= fanout
    return lefts, rights


def _tiers(digests: list[bytes], n: int, levels: int, fanout: int) -> list[list[str]]:
    """The tiers over a bucket of a tree of ``n`` nodes: ``levels`` of them, or as many as the tree has."""
    return climb([bytes(d).hex() for d in digests], min(levels, height(n, fanout)), fanout)


def _bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {fanout**levels}"))


def reduced(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The rounds of ``nodes`` (``g, idx, n, digest``: nodes 0 to n - 1 of each tree g): each the bucket roots of the one before,
    of the trees that had more than one node there. In the last, every tree has one."""
    width = fanout**levels

    def up(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        f = f.sort_values("idx")
        top = _tiers(list(f["digest"]), int(f["n"].iloc[0]), levels, fanout)[-1][0]
        return pd.DataFrame({"g": [key[0]], "idx": [key[1]], "n": [-(-int(f["n"].iloc[0]) // width)], "digest": [bytes.fromhex(top)]})

    rounds = [nodes]
    while not rounds[-1].filter("n > 1").isEmpty():
        rounds.append(cut(_bucketed(rounds[-1].filter("n > 1").select("g", "idx", "n", "digest"), fanout, levels).groupBy("g", "block").applyInPandas(up, NODE)))
    return rounds


def tree_roots(rounds: list[DataFrame]) -> DataFrame:
    """``g, digest``: the one node that is left of each tree."""
    out = None
    for nodes in rounds:
        own = nodes.filter("n = 1").select("g", "digest")
        out = own if out is None else out.unionAll(own)
    return out


def proven(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int, carried: list[str] | None = None) -> DataFrame:
    """The nodes of the first round with their proofs: ``g, idx, digest``, the ``carried`` columns, ``lefts, rights, subroot``.
    ``above`` has what each tree's root begins with: ``g, lefts, rights, subroot``."""
    width, carried = fanout**levels, carried or []

    def down(nodes: pa.Table, uppers: pa.Table, kept: list[str]) -> pa.Table:
        nodes = nodes.sort_by("idx")
        out = nodes.select(["g", "idx", "digest", *kept])
        lefts, rights, subroot = [], [], None
        if len(nodes):
            tiers = _tiers(nodes["digest"].to_pylist(), nodes["n"][0].as_py(), levels, fanout)
            upper = uppers.to_pylist()[0]
            subroot = upper["subroot"]
            own = [siblings(tiers, i % width, fanout) for i in nodes["idx"].to_pylist()]
            lefts, rights = [x + upper["lefts"] for x, _ in own], [x + upper["rights"] for _, x in own]
        texts = pa.list_(pa.string())
        for name, column in (("lefts", pa.array(lefts, texts)), ("rights", pa.array(rights, texts)), ("subroot", pa.array([subroot] * len(nodes), pa.string()))):
            out = out.append_column(name, column)
        return out

    proofs = None
    for t in range(len(rounds) - 1, -1, -1):
        nodes, kept = rounds[t], carried if t == 0 else []
        uppers = nodes.filter("n = 1").select("g", F.lit(0).cast("long").alias("block")).join(above, "g")
        if proofs is not None:
            uppers = uppers.unionByName(proofs.select("g", F.col("idx").alias("block"), "lefts", "rights", "subroot"))
        types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
        schema = ", ".join(["g long", "idx long", "digest binary", *[f"`{c}` {types[c]}" for c in kept], PROOF])
        uppers = uppers.select(F.col("g").alias("tree"), F.col("block").alias("of"), "lefts", "rights", "subroot")  # names of its own, as both come from one table
        pair = _bucketed(nodes, fanout, levels).groupBy("g", "block").cogroup(uppers.groupBy("tree", "of"))
        proofs = pair.applyInArrow(partial(down, kept=kept), schema)  # in Arrow, where ids stay as they are
        if t:
            proofs = cut(proofs)
    return proofs


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (``source, id, digest`` and more) with ``g`` (the source's number), ``idx`` and ``n`` (the leaf's number in its
    source, and how many that has); and the sources with their ``g``."""
    order = ["source", "id", "digest"]
    dealt = leaves.repartitionByRange(partitions(leaves.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()))
    sizes = cut(placed.groupBy("source", "p").agg(F.count(F.lit(1)).alias("n_p"), F.min("k").alias("first")))
    sources = number(sizes.select("source").distinct(), "source", out="g")
    own = Window.partitionBy("source")  # a row for each partition that has the source
    before = F.coalesce(F.sum("n_p").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("source", "p", (F.col("first") - before).alias("zero"), F.sum("n_p").over(own).alias("n"))
    starts = starts.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").alias("s"), F.col("p").alias("at"), "zero", "n", "g")
    starts = maybe_broadcast(cut(starts), sizes.count(), BROADCAST_STARTS)
    rows = placed.join(starts, (F.col("p") == F.col("at")) & F.col("source").eqNullSafe(F.col("s")))
    return rows.withColumn("idx", F.col("k") - F.col("zero")).drop("p", "k", "at", "s", "zero"), sources


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source_col: str = "source", id_col: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, leaf, idx`` (its place in the source), ``subroot, root`` and the proof as
    ``lefts, rights``: of each level from the leaf to the root, the digests left and right of the node in its run, as one text
    each. ``carry`` names further columns, computed from the row (narrow ones, as they travel with the leaf)."""
    carry = carry or {}
    own = {f"c{k}": c for k, c in enumerate(carry.values())}
    leaves = cut(docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"), *[c.alias(k) for k, c in own.items()]))
    nodes, sources = numbered(leaves)
    nodes = cut(nodes)
    rounds = reduced(nodes, fanout, levels)
    subroots = tree_roots(rounds)
    # the tree over the sources: one tree, whose nodes are their roots
    top = cut(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(sources.count()).cast("long").alias("n"), "digest"))
    top_rounds = reduced(top, fanout, levels)
    found = tree_roots(top_rounds).first()  # one row, or none of an empty table
    nothing = top.limit(1).select(F.lit(0).cast("long").alias("g"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.lit("").alias("subroot"))
    above = cut(proven(top_rounds, nothing, fanout, levels).select(F.col("idx").alias("g"), "lefts", "rights", F.lower(F.hex("digest")).alias("subroot")))
    out = proven(rounds, above, fanout, levels, ["source", "id", *own])
    root = bytes(found.digest).hex() if found else None
    return out.select(
        F.col("id").alias("doc_id"), "source", F.lower(F.hex("digest")).alias("leaf"), "idx", "subroot", F.lit(root).cast("string").alias("root"), "lefts", "rights",
        *[F.col(k).alias(name) for k, name in zip(own, carry, strict=True)],
    )


def proof_text(lefts: str = "lefts", rights: str = "rights") -> Column:
    """A proof's siblings from left to right, level by level, as one text."""
    return F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), "")


def folded(leaf: Column, lefts: str = "lefts", rights: str = "rights") -> Column:
    """The root that a leaf (hex) and its proof lead to."""
    return F.aggregate(F.arrays_zip(lefts, rights), leaf, lambda d, x: F.sha2(F.concat(x[lefts], d, x[rights]).cast("binary"), 256))


def verify(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``rows`` of a manifest with ``folded_root``, recomputed from the column ``leaf`` and the proof, and ``verified``."""
    return rows.withColumn("folded_root", folded(F.col(leaf))).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose crc32 is even are tampered with: their text loses its newlines."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = leaf_digest([text if f == "text" else F.col(f) for f in FIELDS])
    rows = verify(manifest(read(spark, sf_dir, "documents"), carry={"now": now}).withColumn("now", F.lower(F.hex("now"))), "now")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text().cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


_FIELD = "case when {0} is null then '-' else octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"""
SQL = f"""
with recursive docs as (
  select *, {_LEAF} as leaf from documents),
altered as (
  select source, doc_id, leaf, {_LEAF} as now from (
    select source, lang, n_chars, doc_id, leaf, case when coalesce({_CRC} % 2 = 0, false) then replace(text, chr(10), '') else text end as text from docs)),
leaves as materialized (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from altered),
tiers as (
  select source, 0 as level, i, n, leaf as d from leaves
  union all
  select source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from tiers where n > 1 group by source, level, i // 3, n),
tops as (
  select 0 as level, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n, d from tiers where n = 1
  union all
  select level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from tops where n > 1 group by level, i // 3, n),
subs as (select source, d as subroot, row_number() over (order by source nulls first) - 1 as g from tiers where n = 1),
near as (
  select l.source, l.i, t.level, coalesce(string_agg(t.d, '' order by t.i) filter (t.i < l.i // pow(3, t.level)::bigint), '') as lefts,
         coalesce(string_agg(t.d, '' order by t.i) filter (t.i > l.i // pow(3, t.level)::bigint), '') as rights
  from leaves l join tiers t on t.source is not distinct from l.source and t.n > 1 and t.i // 3 = l.i // pow(3, t.level + 1)::bigint group by l.source, l.i, t.level),
far as (
  select s.source, 1000 + t.level as level, coalesce(string_agg(t.d, '' order by t.i) filter (t.i < s.g // pow(3, t.level)::bigint), '') as lefts,
         coalesce(string_agg(t.d, '' order by t.i) filter (t.i > s.g // pow(3, t.level)::bigint), '') as rights
  from subs s join tops t on t.n > 1 and t.i // 3 = s.g // pow(3, t.level + 1)::bigint group by s.source, t.level),
steps as materialized (
  select source, i, lefts, rights, row_number() over (partition by source, i order by level) as step from (
    select * from near union all select l.source, l.i, f.level, f.lefts, f.rights from leaves l join far f on f.source is not distinct from l.source)),
folds as (
  select source, i, 0 as step, now as d from leaves
  union all
  select f.source, f.i, s.step, sha256(s.lefts || f.d || s.rights) from folds f join steps s on s.source is not distinct from f.source and s.i = f.i and s.step = f.step + 1),
ends as (select source, i, arg_max(d, step) as folded from folds group by source, i),
proofs as (select source, i, string_agg(lefts || rights, '' order by step) as p from steps group by source, i)
select l.doc_id, l.leaf, s.subroot, r.d as root, sha256(coalesce(p.p, '')) as proof_sha256, e.folded as folded_root, e.folded = r.d as verified
from leaves l join subs s on s.source is not distinct from l.source join ends e on e.source is not distinct from l.source and e.i = l.i
left join proofs p on p.source is not distinct from l.source and p.i = l.i cross join (select d from tops where n = 1) r
"""
