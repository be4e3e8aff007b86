"""The generic join over bitmap blocks: adjacency as ``key, block, w0 ... w7``, a row for each key and block of 512 values that
it has any of, a bit for each value.

Lists are intersected by ``&`` and counted by ``bit_count``, on eight columns, inside whole-stage code: nothing is hashed, and no row
grows with a key's degree, so hubs need no case of their own. It is the form for dense graphs; where a key has few values in
a block the lists of ``generic_join`` are smaller. Values are integers of any sign.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hold
from . import cubes

WORDS = 8
#: log2 of the values in a block.
SHIFT = 9
W = [f"w{i}" for i in range(WORDS)]


def build_bitmaps(df: DataFrame, key: str, value: str, persist: bool = True) -> DataFrame:
    """``key, block, w0 ... w7`` of the pairs of two columns; duplicates count once, nulls go. One exchange, with partial ors."""
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value")).filter("key is not null and value is not null")
    bit = F.expr("shiftleft(1L, cast(value & 63 as int))")
    word = F.expr(f"cast(shiftright(value, 6) & {WORDS - 1} as int)")
    ors = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(W)]
    out = rows.groupBy("key", F.shiftright("value", SHIFT).alias("block")).agg(*ors)
    return hold(out) if persist else out


def _any() -> Column:
    return reduce(lambda a, b: a | b, [F.col(w) != 0 for w in W])


def narrowed(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``block, w0 ... w7``, the bits narrowed to those that ``index`` has for ``key``; rows left without any go."""
    own = index.select(F.col("key").alias("__k"), F.col("block").alias("__block"), *[F.col(w).alias(f"__{w}") for w in W])
    joined = rows.join(own, (F.col(key) == F.col("__k")) & (F.col("block") == F.col("__block")))
    return joined.withColumns({w: F.col(w).bitwiseAND(F.col(f"__{w}")) for w in W}).drop("__k", "__block", *[f"__{w}" for w in W]).filter(_any())


def extend_bits(prefixes: DataFrame, atoms: list[tuple[DataFrame, str]]) -> DataFrame:
    """``prefixes`` with ``block, w0 ... w7``, the values that every atom (an index and the prefix column that is its key) allows, in
    as many rows as they have blocks."""
    index, key = atoms[0]
    own = index.withColumnRenamed("key", "__k")
    found = prefixes.join(own, F.col(key) == F.col("__k")).drop("__k")
    for index, key in atoms[1:]:
        found = narrowed(found, index, key)
    return found


def counted() -> Column:
    """The number of a row's bits."""
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in W]).cast("long")


def expand_bits(rows: DataFrame, new: str, keep: bool = False) -> DataFrame:
    """A row for each bit, its value as ``new``; with ``keep`` the block and its words stay, as ``block, w0 ... w7``."""
    words = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(w).alias("w")) for i, w in enumerate(W)]))
    split = rows.withColumn("__x", words).filter("__x.w <> 0")
    bytes_ = F.explode(F.array(*[F.struct(F.lit(8 * i).alias("i"), F.shiftrightunsigned("__x.w", 8 * i).bitwiseAND(255).cast("int").alias("b")) for i in range(8)]))
    # words and bytes without bits are passed over before their bits become rows
    split = split.withColumn("__y", bytes_).filter("__y.b <> 0").withColumn("__z", F.explode(F.array(*[F.lit(i) for i in range(8)]))).filter("shiftright(__y.b, __z) & 1 = 1")
    value = F.shiftleft("block", SHIFT) + F.col("__x.i") * 64 + F.col("__y.i") + F.col("__z")
    left = [c for c in rows.columns if keep or c not in ("block", *W)]
    return split.select(*left, value.cast("long").alias(new))


def clique_bits(e: DataFrame, k: int) -> DataFrame:
    """Cliques of k - 1 vertices (columns a, b, ...) with the bits of their k-th, a row for each block, by the blocks of :mod:`cubes`: a
    clique's bits are those of the one it came from, narrowed by its newest vertex where all triangles of its first one are."""
    from .motifs import NAMES

    rows = e.select(F.col("src").alias("key"), F.col("dst").alias("value"))
    return cubes.triangle_bits(rows) if k == 3 else cubes.clique_bits(rows, list(NAMES[: k - 1]))


def clique_count(e: DataFrame, k: int, out: str = "cliques") -> DataFrame:
    """The number of cliques of k vertices, k at least 3: of triangles for k = 3. Others are counted vertex by vertex from its
    triangles, over edges from lower to higher degree, so that a vertex has no more than the root of twice the edges."""
    rows = e.select(F.col("src").alias("key"), F.col("dst").alias("value"))
    return cubes.triangle_number(rows, bits=True, out=out) if k == 3 else cubes.clique_number(cubes.oriented_by_degree(rows), k, out)


def cliques(e: DataFrame, k: int) -> DataFrame:
    """Cliques of k vertices listed, as ``motifs.cliques`` does."""
    from .motifs import NAMES

    return expand_bits(clique_bits(e, k), NAMES[k - 1])
