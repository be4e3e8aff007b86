"""Weakly connected components, labelled by their smallest vertex.

Edges are rewritten by alternating large-star and small-star steps, which bring every vertex next to its component's
minimum in about log(n) rounds whatever the diameter. Each step is a partial minimum and an equi-join on a vertex, so hubs
are subject to map-side combining and AQE's skew handling; nothing is gathered by component. Optionally each input
partition is first reduced to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .prep import vertices

#: Edges that a task holds at a time beside its forest, and edges of a forest at most: 16 bytes each, several times while it is made.
CHUNK, MOST = 1 << 20, 1 << 23


def forest(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Places of the edges that make a spanning forest. In each round every tree that has a smaller neighbour is hung below the
    smallest such root, by one of the edges between the two, and all trees are made flat by pointer jumping; edges inside a tree go."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root, place, kept = np.arange(len(ids)), np.arange(len(src)), []
    a, b = ends[: len(src)], ends[len(src) :]
    while len(place):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        open_ = high != low
        a, b, place, high, low = (x[open_] for x in (a, b, place, high, low))
        order = np.lexsort((low, high))  # the first of a root's edges leads to its smallest neighbour
        hung, first = np.unique(high[order], return_index=True)
        kept.append(place[order[first]])
        root[hung] = low[order[first]]
        while not np.array_equal(up := root[root], root):
            root = up
    return np.sort(np.concatenate([np.empty(0, np.int64), *kept]))


def local_forests(e: DataFrame, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """A spanning forest of each partition: the same components overall. A task's forest and new edges, at least ``chunk`` of
    them and as many as the forest has, are made one forest. One of ``most`` edges is passed on as it is and the next one begun,
    which bounds what a task holds; the two are left for the star steps to unite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, new, n = np.empty((2, 0), np.int64), [], 0

        def reduced() -> np.ndarray:
            both = np.concatenate([kept, *new], axis=1)
            return both[:, forest(both[0], both[1])]

        for batch in batches:
            new.append(np.stack([batch.column(k).to_numpy() for k in range(2)]))
            n += len(batch)
            if n >= max(chunk, kept.shape[1]):
                kept, new, n = reduced(), [], 0
                if kept.shape[1] >= most:
                    yield pa.record_batch([pa.array(kept[0]), pa.array(kept[1])], names=["src", "dst"])
                    kept = np.empty((2, 0), np.int64)
        kept = reduced()
        yield pa.record_batch([pa.array(kept[0]), pa.array(kept[1])], names=["src", "dst"])

    return e.select("src", "dst").mapInArrow(run, "src long, dst long")


def merged_forests(e: DataFrame, levels: int = 2, fan: int = 4) -> DataFrame:
    """:func:`local_forests`, and ``levels`` times those of about ``fan`` partitions made one forest. Each level leaves at most
    its partitions times the vertices, or all edges beyond what a task may hold (see :func:`local_forests`); levels stop at two
    partitions and the star steps do the rest."""
    e, parts = local_forests(e), int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(levels):
        parts = max(parts // fan, 2)
        e = local_forests(e.repartition(parts, "src", "dst"))
    return e


def placed_forests(e: DataFrame, kind: str = "hhp", **grid: int) -> DataFrame:
    """Forests of a two-dimensional placement's parts (see ``prep.placement_levels``), and level by level one forest of all parts
    that a group unites. A part has its edges' vertices only: with n x n groups about 2 / n of all of them. The last level's
    forests are left for the star steps to unite."""
    from .prep import placement_levels

    for part, parts in placement_levels(kind, **grid):
        e = local_forests(e.repartition(parts, part))
    return e


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    lower = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return lower.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(state: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour and none of these has one itself: then that is its component's minimum."""
    several = state.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    inner = state.select("b").distinct().join(state.select(F.col("a").alias("b")), "b", "left_semi")
    return several.limit(1).unionAll(inner.limit(1)).isEmpty()


def star_edges(e: DataFrame, most: int = 60) -> DataFrame:
    """``v, label`` for every vertex that is not its component's minimum."""
    state = cut(e.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    for _ in range(most):
        if _settled(state):
            return state.select(F.col("a").alias("v"), F.col("b").alias("label"))
        state = cut(_small_star(_large_star(state)))
    raise RuntimeError(f"components did not settle in {most} rounds")


def labels(e: DataFrame, pre_reduce: bool = False) -> DataFrame:
    """``v, label`` with ``label`` the smallest vertex of v's component."""
    stars = star_edges(local_forests(e) if pre_reduce else e)
    return vertices(e).join(stars, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def forest_size(e: DataFrame, pre_reduce: bool = True) -> DataFrame:
    """Vertices minus components: one row ``forest_edges``."""
    return star_edges(local_forests(e) if pre_reduce else e).agg(F.count(F.lit(1)).alias("forest_edges"))


def sizes(e: DataFrame) -> DataFrame:
    return labels(e).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def propagate(e: DataFrame, most: int = 1000) -> DataFrame:
    """Plain minimum-label propagation, stopping when the sum of labels no longer falls: as many rounds as the largest
    distance to a component's minimum. Kept for differential tests and small diameters."""
    from .iterate import until
    from .prep import symmetrize

    both = symmetrize(e)

    def step(state: DataFrame) -> DataFrame:
        near = both.join(state.select(F.col("v").alias("src"), "label"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("label").alias("near"))
        return state.join(near, "v", "left").select("v", F.least("label", "near").alias("label"))

    return until(vertices(e).select("v", F.col("v").alias("label")), step, lambda s: s.agg(F.sum("label")).first()[0], most)
