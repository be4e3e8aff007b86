"""PageRank in five formulations that do not agree with each other, over directed edges.

``dataflow``: mass starts at the sources only and every round passes on ``damping / degree`` of the last delta; ranks are the
sum of all deltas. ``disk``: all vertices start at ``reset``; sources send and fall back to ``reset``, a vertex that never
sends keeps what it has. ``memory``: as ``disk`` without any fall-back, so mass decays. ``step``: one textbook round from a
given vector. ``joined`` and ``blocks``: rounds of that step from zero. Weights ``1 / degree`` are joined to the edges once and
held; how they are dealt is left to the planner, which can split a source with very many edges.

``blocks`` never moves an edge between rounds: edges are packed along the Hilbert curve, a bounded number to a block, so that a
block is about a square of the adjacency matrix, with few sources and few targets for its edges. A round sends each block the
values of its own sources and takes one sum for each of its targets. It pays on graphs with many edges a vertex, or whose
numbering puts neighbours together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hilbert import with_key
from ..session import cut, hold
from .iterate import iterate_and_accumulate
from .prep import number, out_degree, vertices


def weighted(e: DataFrame) -> DataFrame:
    """``src, dst, w`` with ``w = 1 / out-degree``, held."""
    deg = out_degree(e).select(F.col("v").alias("src"), (1.0 / F.col("degree")).alias("w"))
    return hold(e.join(deg, "src"))


def push(edges: DataFrame, ranks: DataFrame, share: float) -> DataFrame:
    """``v, value`` sent along the edges and added up at the targets: ``share * value * w``."""
    sent = edges.join(ranks.select(F.col("v").alias("src"), "value"), "src")
    return sent.groupBy(F.col("dst").alias("v")).agg(F.sum(F.lit(share) * F.col("value") * F.col("w")).alias("value"))


def dataflow(e: DataFrame, rounds: int = 20, reset: float = 0.15, damping: float = 0.85) -> DataFrame:
    edges = weighted(e)
    start = edges.select(F.col("src").alias("v")).distinct().withColumn("value", F.lit(reset))
    deltas = iterate_and_accumulate(start, lambda d: push(edges, d.filter("value > 0"), damping), rounds)
    return deltas.groupBy("v").agg(F.sum("value").alias("rank")).filter("rank > 0")


#: Edges of a block, which one task holds at a time: 8 bytes each, and 16 for each end that is new in the block.
BLOCK = 1 << 20


def packed(e: DataFrame, most: int = BLOCK) -> DataFrame:
    """Blocks of ``most`` edges that follow one another along the Hilbert curve, the last one with fewer: ``part``, the distinct
    ``sources`` and ``targets``, ascending, and for each edge their places there (``at``, ``to``). An edge's block comes from its
    place on the whole curve, so blocks do not get smaller with more partitions, and a hub's edges are split as any others. Kept
    as a table, as edges with equal keys need not come out in the same order twice."""

    def pack(table: pa.Table) -> pa.Table:
        sources, at = np.unique(table["src"].to_numpy(), return_inverse=True)
        targets, to = np.unique(table["dst"].to_numpy(), return_inverse=True)
        arrays = [table["part"][:1].combine_chunks()] + [pa.array([x], pa.list_(kind)) for x, kind in ((sources, pa.int64()), (targets, pa.int64()), (at.astype(np.int32), pa.int32()), (to.astype(np.int32), pa.int32()))]
        return pa.table(arrays, names=["part", "sources", "targets", "at", "to"])

    placed = number(with_key(e.select("src", "dst")), "hilbert_key", out="place")
    dealt = placed.select("src", "dst", F.floor(F.col("place") / F.lit(most)).alias("part")).groupBy("part")
    return cut(dealt.applyInArrow(pack, "part long, sources array<long>, targets array<long>, at array<int>, to array<int>"))


def block_push(e: DataFrame, most: int = BLOCK) -> Callable[[DataFrame, float], DataFrame]:
    """:func:`push` over the edges ``e`` by blocks: a function of the ranks and the share."""
    blocks = packed(e, most)
    deg = out_degree(e).select(F.col("v").alias("src"), (1.0 / F.col("degree")).alias("w"))
    wanted = hold(blocks.select("part", F.explode("sources").alias("src")).join(deg, "src"))
    # where each round finds them
    blocks = hold(blocks.withColumnRenamed("part", "block").repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block"))
    blocks.count()  # once computed, their partitioning is known to the planner

    def add(block: pa.Table, came: pa.Table) -> pa.Table:
        schema = pa.schema([("v", pa.int64()), ("value", pa.float64())])
        if not len(block):
            return schema.empty_table()
        sources, targets, at, to = (block[c].combine_chunks().flatten().to_numpy() for c in ("sources", "targets", "at", "to"))
        values = np.zeros(len(sources))
        values[np.searchsorted(sources, came["src"].to_numpy())] = came["value"].to_numpy()
        return pa.table([pa.array(targets), pa.array(np.bincount(to, values[at], len(targets)))], schema=schema)

    def run(ranks: DataFrame, share: float) -> DataFrame:
        sent = wanted.join(ranks.select(F.col("v").alias("src"), "value"), "src").select("part", "src", (F.lit(share) * F.col("value") * F.col("w")).alias("value"))
        sums = blocks.groupBy("block").cogroup(sent.groupBy("part")).applyInArrow(add, "v long, value double")
        return sums.groupBy("v").agg(F.sum("value").alias("value"))

    return run


def _rounds(e: DataFrame, start: float, rounds: int, share: float, base: Column, every: int = 1, send: Callable[[DataFrame, float], DataFrame] | None = None) -> DataFrame:
    """Rounds over the whole vertex frame ``v, value, sends``: ``base`` plus what comes in, by the edge join or by ``send``."""
    edges = e if send else weighted(e)
    sources = edges.select(F.col("src").alias("v")).distinct().withColumn("sends", F.lit(True))
    frame = cut(vertices(e).join(sources, "v", "left").select("v", F.lit(start).alias("value"), F.coalesce("sends", F.lit(False)).alias("sends")))
    for k in range(1, rounds + 1):
        came = (send(frame, share) if send else push(edges, frame, share)).withColumnRenamed("value", "came")
        frame = frame.join(came, "v", "left").select("v", (base + F.coalesce("came", F.lit(0.0))).alias("value"), "sends")
        if k % every == 0 and k < rounds:
            frame = cut(frame)
    return frame.select("v", F.col("value").alias("rank"))


def disk(e: DataFrame, rounds: int = 20, reset: float = 0.85) -> DataFrame:
    return _rounds(e, reset, rounds, 1 - reset, F.when(F.col("sends"), F.lit(reset)).otherwise(F.col("value")))


def memory(e: DataFrame, rounds: int = 20, reset: float = 0.85, start: float | None = None) -> DataFrame:
    return _rounds(e, reset if start is None else start, rounds, 1 - reset, F.lit(0.0))


def joined(e: DataFrame, rounds: int = 20, reset: float = 0.85) -> DataFrame:
    return _rounds(e, 0.0, rounds, 1 - reset, F.lit(reset))


def blocks(e: DataFrame, rounds: int = 20, reset: float = 0.85, most: int = BLOCK) -> DataFrame:
    """As :func:`joined`, by blocks. Ids are from 0 to 2^31 - 1 (others raise; ``prep.dense_rename`` makes such)."""
    e = hold(e)
    return _rounds(e, 0.0, rounds, 1 - reset, F.lit(reset), send=block_push(e, most))


def step(e: DataFrame, ranks: DataFrame, reset: float = 0.85) -> DataFrame:
    """One round from ``ranks`` (``v, value``) over all vertices of ``e``."""
    came = push(weighted(e), ranks, 1 - reset).withColumnRenamed("value", "came")
    return vertices(e).join(came, "v", "left").select("v", (F.lit(reset) + F.coalesce("came", F.lit(0.0))).alias("rank"))


VARIANTS = {"dataflow": dataflow, "disk": disk, "memory": memory, "joined": joined, "blocks": blocks}


def pagerank(e: DataFrame, variant: str = "dataflow", **parameters) -> DataFrame:
    return VARIANTS[variant](e, **parameters)
