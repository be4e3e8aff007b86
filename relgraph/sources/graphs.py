"""Edge relations: the schema, and graphs drawn from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import following

EDGE_SCHEMA = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])


def edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Any two columns as ``src, dst`` long; rows with a null endpoint go, as the model has none."""
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src is not null and dst is not null")


def local_edges(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(pairs, EDGE_SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_occurrence(rows: DataFrame, group: str, item: str, distinct: bool = True) -> DataFrame:
    """Unordered pairs of distinct items that share a group, smaller id first; without ``distinct`` once for each such group. Both
    sides of the join are one exchange."""
    items = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    a, b = items.withColumnRenamed("i", "src"), items.withColumnRenamed("i", "dst")
    pairs = a.join(b, "g").filter("src < dst").select("src", "dst")
    return pairs.distinct() if distinct else pairs


def copart(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    return co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", distinct)


def copart_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_occurrence(table(spark, sf_dir, "lineitem").filter("l_quantity >= 40 and l_returnflag = 'R'"), "l_orderkey", "l_partkey")


def copart_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-purchase among returned lines: sparse, with a large clique for each order that came back."""
    return co_occurrence(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), "l_orderkey", "l_partkey")


def trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user to the next event's, in the order of time and id over the whole table."""
    pairs = following(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", out="dst")
    return pairs.select(F.col("user_id").alias("src"), "dst").filter("dst is not null and src <> dst").distinct()


def ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").filter("src <> dst").distinct()
