"""The lexicographically first maximal independent set, by rounds on the symmetrised graph.

Every round decides the undecided vertices below all undecided neighbours: they are in, and their neighbours out. A vertex with
one smaller undecided neighbour is in exactly if that one is out, so chains of such vertices follow from their first one by the
parity of the distance, which pointer jumping finds in about log(length) steps. Rounds jump once ``PLAIN`` of them have not
decided all, so a path in the order of its ids takes few rounds, and graphs with ids in random order pay nothing for it.

Where rounds still decide little, as decisions wait for each other in long chains of several smaller neighbours, the smallest
undecided ids that have up to ``BLOCK_EDGES`` edges among them are decided in one pass in the order of their ids, which needs
nothing of larger ones. So every graph ends: rounds that decide less than an eighth are no more than the edges left by
``BLOCK_EDGES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .prep import drop_self_loops, symmetrize, vertices

PLAIN = 6
#: Edges of a block that one task decides: 32 MB of ids, read in the order of the larger end.
BLOCK_EDGES = 1 << 21
#: Ranges of ids that are counted at a time to find a block's end.
RANGES = 1024


def _firsts(smaller: DataFrame) -> DataFrame:
    """``v, root, odd`` of each vertex with just one smaller undecided neighbour: the end of its chain, a vertex with none or
    several, and whether the way there is odd. ``smaller``: ``v, u`` with u < v, both undecided."""
    one = smaller.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("root")).filter("n = 1")
    at = cut(one.select("v", "root", F.lit(True).alias("odd")))
    while True:
        onward = at.select(F.col("v").alias("root"), F.col("root").alias("next"), F.col("odd").alias("more"))
        if at.join(onward, "root", "left_semi").isEmpty():
            return at
        joined = at.join(onward, "root", "left")
        at = cut(joined.select("v", F.coalesce("next", "root").alias("root"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd")))


def _block_end(work: DataFrame, edges: int) -> int | None:
    """The largest id up to which vertices have at most ``edges`` smaller neighbours and vertices together, by counts over ever
    narrower ranges of ids; None if the first one alone has more. ``work``: ``v, u``, u smaller or null."""
    low, high = work.agg(F.min("v"), F.max("v")).first()
    end, room = None, edges
    while low <= high:
        width = -(-(high - low + 1) // RANGES)
        counts = work.filter(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - low) / width).alias("r")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(counts.collect()):  # RANGES rows at most
            if r.n > room:
                low, high = low + r.r * width, min(high, low + (r.r + 1) * width - 1)
                break
            room -= r.n
            end = min(high, low + (r.r + 1) * width - 1)
        else:
            return high
        if width == 1:
            return end
    return end


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``v, u`` in the order of v to the vertices that are in: those with no smaller neighbour u that is."""
    taken: set[int] = set()
    now, free = None, False
    for batch in batches:
        v, u = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        fresh = []
        for a, b in zip(v.tolist(), u, strict=True):
            if a != now:
                if free:
                    taken.add(now)
                    fresh.append(now)
                now, free = a, True
            free = free and b not in taken
        yield pa.record_batch([pa.array(fresh, pa.int64())], names=["v"])
    if free:
        yield pa.record_batch([pa.array([now], pa.int64())], names=["v"])


def _block(undecided: DataFrame, both: DataFrame, edges: int) -> DataFrame | None:
    """The vertices that are in, of the smallest undecided ones."""
    smaller = both.filter("src > dst").select(F.col("src").alias("v"), F.col("dst").alias("u"))
    work = smaller.unionAll(undecided.select("v", F.lit(None).cast("long").alias("u")))
    end = _block_end(work, edges)
    if end is None:
        return None
    # the one task gets `edges` rows at most
    return cut(work.filter(F.col("v") <= end).repartition(1).sortWithinPartitions("v").mapInArrow(_decide, "v long"))


def maximal_independent_set(e: DataFrame, plain: int = PLAIN, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``v``: a vertex is in unless a smaller neighbour is."""
    both = cut(symmetrize(drop_self_loops(e)))
    undecided, chosen, k, slow = cut(vertices(e)), None, 0, False
    left = undecided.count()
    while True:
        new, out = (_block(undecided, both, block_edges) if slow else None), None
        if new is None:
            least = both.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("m"))
            new = cut(undecided.join(least, "v", "left").filter("m is null or v < m").select("v"))
            if k >= plain:
                chains = _firsts(both.filter("src > dst").select(F.col("src").alias("v"), F.col("dst").alias("u")))
                told = chains.join(new.withColumnRenamed("v", "root"), "root", "left_semi")
                new, out = cut(new.unionAll(told.filter("not odd").select("v"))), told.filter("odd").select("v")
        chosen = new if chosen is None else chosen.unionAll(new)
        gone = new.unionAll(both.join(new.withColumnRenamed("v", "src"), "src", "left_semi").select(F.col("dst").alias("v")))
        gone = (gone if out is None else gone.unionAll(out)).distinct()
        undecided = cut(undecided.join(gone, "v", "left_anti"))
        before, left, k = left, undecided.count(), k + 1
        if not left:
            return chosen
        slow = slow or (k > plain and (before - left) * 8 < before)
        stay = undecided.withColumnRenamed("v", "src")
        both = cut(both.join(stay, "src", "left_semi").join(stay.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
