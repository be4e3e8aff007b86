"""What every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir  # noqa: F401

ensure_checkpoint_dir = shared_dir


def maybe_broadcast(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``bound``; beyond it, left to the shuffle joins."""
    return F.broadcast(df) if rows <= bound else df


#: A key with more than one in so many of all rows is dealt over many tasks; so there are fewer such keys than this.
HEAVY_PARTS = 1024


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and in ``weight`` (dropped) about how many of the
    ``total`` rows have it. Keys with more than ``1 / HEAVY_PARTS`` of all rows (fewer than ``HEAVY_PARTS`` keys, broadcast)
    are salted: their rows are dealt over the shuffle's tasks and their row of ``table`` goes to each.

    ``rows`` come from files or a checkpoint by narrow steps only, so that a task that runs again deals them alike."""
    salts = partitions(rows.sparkSession)
    light = F.col(weight) <= total / HEAVY_PARTS
    heavy = F.broadcast(table.filter(~light).select(F.col(key).alias("__key")))
    dealt = rows.join(heavy, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.when(F.col("__key").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(salts))).cast("int")).drop("__key")
    copies = table.withColumn("__salt", F.explode(F.when(light, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop(weight)
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of a row's id and text, by which rows with one id, or without, are told apart by what they say. Null and empty
    texts of one id are alike."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
