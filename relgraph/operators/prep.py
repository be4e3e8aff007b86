"""Graph preparation: normalising, degrees, orientation, renaming and two-dimensional partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drop_self_loops(e: DataFrame) -> DataFrame:
    return e.filter(F.col("src") != F.col("dst"))


def normalize(e: DataFrame) -> DataFrame:
    """No self-loops, smaller id first, each edge once."""
    return drop_self_loops(e).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def transpose(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(e: DataFrame, distinct: bool = True) -> DataFrame:
    both = e.select("src", "dst").unionAll(transpose(e))
    return both.distinct() if distinct else both


def vertices(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def out_degree(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def in_degree(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def degree(e: DataFrame) -> DataFrame:
    """In- and out-degree added, over the edges as given."""
    return e.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def _with_values(e: DataFrame, values: DataFrame) -> DataFrame:
    """``src, dst, a, b``: a vertex attribute ``v, value`` at both ends."""
    a = values.select(F.col("v").alias("src"), F.col("value").alias("a"))
    b = values.select(F.col("v").alias("dst"), F.col("value").alias("b"))
    return e.join(a, "src").join(b, "dst")


def _swap_unless(e: DataFrame, keep: Column) -> DataFrame:
    return e.select(F.when(keep, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(keep, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def _degrees(e: DataFrame) -> DataFrame:
    return degree(e).withColumnRenamed("degree", "value")


def orient_by_degree(e: DataFrame) -> DataFrame:
    """From lower to higher degree; of equal degrees, from the smaller to the larger id."""
    return _swap_unless(_with_values(e, _degrees(e)), (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("src") < F.col("dst"))))


def swap_by_degree(e: DataFrame) -> DataFrame:
    """Swapped only where the source has the higher degree; ties stay as they are."""
    return _swap_unless(_with_values(e, _degrees(e)), F.col("a") <= F.col("b"))


def orient_by_value(e: DataFrame, values: DataFrame) -> DataFrame:
    """Kept only where the source's value is the lower one; ties are swapped. ``values``: ``v, value``."""
    return _swap_unless(_with_values(e, values), F.col("a") < F.col("b"))


def work_per_vertex(e: DataFrame) -> DataFrame:
    """``v, work``: over the edges oriented by degree, the degrees of the high ends added up at their low end."""
    low = orient_by_degree(e)
    high = degree(e).select(F.col("v").alias("dst"), F.col("degree"))
    return low.join(high, "dst").groupBy(F.col("src").alias("v")).agg(F.sum("degree").alias("work"))


def assess_work(e: DataFrame) -> DataFrame:
    return work_per_vertex(e).agg(F.coalesce(F.max("work"), F.lit(0)).alias("max_work"))


def number(ids: DataFrame, *order: Column | str, out: str = "new") -> DataFrame:
    """Dense numbers from 0 in the given order without sorting in one task: rows are range-partitioned and sorted, counted
    for each partition, and each partition starts at the sum of those before it."""
    from ..session import cut

    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(ids.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__k").alias("__first"))  # one row a partition
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(starts.drop("__n")), "__p").withColumn(out, F.col("__k") - F.col("__first") + F.col("__start")).drop("__p", "__k", "__first", "__start")


def following(rows: DataFrame, value: str, *order: str, out: str = "next") -> DataFrame:
    """Each row with the next row's ``value`` in a total order, null in the last: numbers joined to numbers less one, so no
    task sorts all rows."""
    at = number(rows, *order, out="__at")
    after = at.select((F.col("__at") - 1).alias("__at"), F.col(value).alias(out))
    return at.join(after, "__at", "left").drop("__at")


def rename(e: DataFrame, names: DataFrame) -> DataFrame:
    """Both endpoints replaced by way of a dictionary ``v, new``; a multigraph stays one."""
    a = names.select(F.col("v").alias("src"), F.col("new").alias("__s"))
    b = names.select(F.col("v").alias("dst"), F.col("new").alias("__d"))
    return e.join(a, "src").join(b, "dst").select(F.col("__s").alias("src"), F.col("__d").alias("dst"))


def dense_names(e: DataFrame) -> DataFrame:
    return number(vertices(e), "v")


def random_names(e: DataFrame, seed: int = 0) -> DataFrame:
    """A permutation of 0..n-1: vertices in the order of a multiplicative hash, which plain SQL can follow."""
    return number(vertices(e).withColumn("__h", (F.col("v") * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)), "__h", "v").drop("__h")


def first_touch_names(e: DataFrame, pos: str) -> DataFrame:
    """Dense ids in the order of first appearance; at one position the source comes before its target."""
    touched = e.select(F.explode(F.array(F.struct(F.col("src").alias("v"), (F.col(pos) * 2).alias("at")), F.struct(F.col("dst").alias("v"), (F.col(pos) * 2 + 1).alias("at")))).alias("x"))
    return number(touched.select("x.v", "x.at").groupBy("v").agg(F.min("at").alias("__at")), "__at").drop("__at")


def partition_expr(kind: str, p: int = 2, q: int = 2, threads: int = 2, groups: int = 2, another: int = 2) -> Column:
    """The part of an edge in five two-dimensional placements: ``sp`` (p x q parts), ``pp`` (blocks of ``threads``), ``op`` (one
    part in every ``threads``), ``hp`` (groups x groups, then local x local), ``hhp`` (the same with ``another`` times the groups,
    which :func:`placement_levels` joins again in two steps)."""
    s, t = F.col("src"), F.col("dst")
    if kind == "sp":
        return (s % p) + p * (t % q)
    if kind == "pp":
        return (s % p) + threads * (t % q)
    if kind == "op":
        return threads * ((s % p) + p * (t % q))
    if kind == "hp":
        return ((s % groups) + groups * (t % groups)) * threads + (F.floor(s / groups) % p) + p * (F.floor(t / groups) % q)
    if kind == "hhp":
        return partition_expr("hp", p, q, threads, groups * another)
    raise ValueError(f"unknown placement: {kind}")


def placement_levels(kind: str, p: int = 2, q: int = 2, groups: int = 2, another: int = 2) -> list[tuple[Column, int]]:
    """The placement's parts and, level by level, the groups that unite them, each with their number: an edge's group follows
    from its part. ``hp``: parts, then groups; ``hhp``: parts, groups x another, then another; all others: parts only."""
    grid = lambda n: ((F.col("src") % n) + n * (F.col("dst") % n), n * n)
    if kind == "hp":
        return [(partition_expr("hp", p, q, p * q, groups), groups * groups * p * q), grid(groups)]
    if kind == "hhp":
        return [(partition_expr("hhp", p, q, p * q, groups, another), (groups * another) ** 2 * p * q), grid(groups * another), grid(another)]
    return [(partition_expr(kind, p, q), p * q)]


def place(e: DataFrame, part: Column, parts: int) -> DataFrame:
    """Edges dealt to ``parts`` partitions by ``part`` and sorted by source within each."""
    return e.withColumn("part", part.cast("long")).repartition(parts, "part").sortWithinPartitions("part", "src", "dst")


def adjacency(e: DataFrame, chunk: int | None = None) -> DataFrame:
    """``src, degree, neighbours`` (sorted); with ``chunk``, long lists as several rows of at most so many. Chunks come from the
    edges' numbers in order of source and target, so no task gathers or sorts a hub's whole list."""
    if chunk is None:
        rows = e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
        return rows.select("src", F.size("neighbours").cast("long").alias("degree"), "neighbours")
    numbered = number(e.select("src", "dst"), "src", "dst", out="at").join(offsets(e), "src")
    rows = numbered.withColumn("chunk", F.floor((F.col("at") - F.col("first")) / chunk).cast("int"))
    return rows.groupBy("src", "degree", "chunk").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def offsets(e: DataFrame) -> DataFrame:
    """``src, degree, first``: where a source's edges start when edges are sorted by source."""
    sizes = out_degree(e).withColumnRenamed("v", "src")
    block = F.floor(F.col("src") / 65536)
    sizes = sizes.withColumn("block", block)
    totals = sizes.groupBy("block").agg(F.sum("degree").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("block").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("own", F.coalesce(F.sum("degree").over(own), F.lit(0))).join(starts, "block").select("src", "degree", (F.col("start") + F.col("own")).alias("first"))


def unconserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Vertices whose in- or out-degree differs between two forms of one graph; empty when edges are conserved."""
    tally = lambda e: out_degree(e).withColumn("side", F.lit("out")).unionAll(in_degree(e).withColumn("side", F.lit("in")))
    a, b = tally(before), tally(after)
    return a.exceptAll(b).unionAll(b.exceptAll(a))
