"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries, one for each partition and merged, name every digest that may hold more than ``1 / counters`` of
the rows. The candidates are counted exactly and those that are truly frequent are broadcast (at most ``counters`` rows,
whatever the input), so their rows are resolved map-side and never meet in one task. All other digests go through an
ordinary shuffle, in which no key has more than ``1 / counters`` of the rows.

Defined results: a null text counts as empty and equals other empty texts; a null ``doc_id`` sorts below every other id;
of fully repeated rows (same id, same text) exactly one is kept; an empty table gives an empty result; columns other than
the id and the text are ignored by :func:`exact_groups` and passed through by :func:`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, maybe_broadcast, read

#: Counters of a Misra-Gries summary; also the bound on the rows of the broadcast.
COUNTERS = 1024


def misra_gries(counts: dict[bytes, int], keys: np.ndarray, more: np.ndarray, counters: int) -> dict[bytes, int]:
    """Merge a batch of distinct ``keys`` with their counts into a summary of at most ``counters`` keys.

    After adding the batch exactly, the (counters + 1)-th largest count is taken off every counter and those at or below
    zero go: the mergeable form of the summary, whose undercount is at most n / (counters + 1) for n rows."""
    for key, n in zip(keys, more, strict=True):
        counts[key] = counts.get(key, 0) + int(n)
    if len(counts) <= counters:
        return counts
    off = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -counters - 1)[-counters - 1])
    return {k: n - off for k, n in counts.items() if n > off}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            values = pa.table([batch.column(0)], names=["digest"]).group_by("digest").aggregate([([], "count_all")])
            counts = misra_gries(counts, np.array(values["digest"].to_pylist(), dtype=object), values["count_all"].to_numpy(), counters)
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest, winner, group_size`` of every digest with more than ``1 / counters`` of all rows of ``digests``
    (``digest, doc_id, uid``), counted exactly: fewer than ``counters`` rows."""
    total = digests.count()
    found = (
        digests.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
        # each partition undercounts by its rows / (counters + 1) at most, so all of them by total / (counters + 1)
        .filter(F.col("n") + total / (counters + 1) > total / counters)
        .select("digest")
    )
    found = cut(found)
    rows = found.count()  # of partition-local survivors only those near the threshold are left
    exact = (
        digests.join(maybe_broadcast(found, rows, 64 * counters), "digest", "left_semi")
        .groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > total / counters)
    )
    return cut(exact)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, digest`` (SHA-256, 32 bytes), ``keep_id`` (of equal texts, the largest
    id), ``group_size, kept``."""
    digests = cut(
        docs.select(
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("uid"),  # fixed by the checkpoint; only parts repeated rows
        )
    )
    heavy = frequent(digests, counters)
    tagged = digests.join(F.broadcast(heavy), "digest", "left")  # fewer than `counters` rows by construction
    of_heavy = tagged.filter("group_size is not null")
    rest = tagged.filter("group_size is null").select("digest", "doc_id", "uid")
    sizes = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    done = of_heavy.select("digest", "doc_id", "uid", "winner", "group_size").unionByName(rest.join(sizes, "digest"))
    return done.select(
        "doc_id", "digest", F.col("winner.doc_id").alias("keep_id"), "group_size", (F.col("winner.uid") == F.col("uid")).alias("kept")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs``, all columns, without exact copies: of equal texts the one with the largest id stays, once."""
    winners = exact_groups(docs, id_col, text_col, counters).filter("kept").select("doc_id", "digest")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    # rows travel as one struct, so that no column of theirs can clash with these
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest.alias("own"))
    # a group has one winner, so several rows of one (id, digest) are repeats of it: told by a count over narrow rows
    repeats = cut(rows.groupBy("id", "own").count().filter("count > 1").select(F.col("id").alias("doc_id"), F.col("own").alias("digest")))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own"))
    kept = rows.join(winners, same, "left_semi")
    if repeats.isEmpty():
        return kept.select("row.*")
    once = kept.join(repeats, same, "left_anti")
    repeated = kept.join(repeats, same, "left_semi").dropDuplicates(["own"])
    return once.unionByName(repeated).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id,
       max(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from d
"""
