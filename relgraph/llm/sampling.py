"""Bounded, deterministic samples for fitting models, fitting in a task, and the split that is never learned from."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chosen_rows(rows: DataFrame, label: str, counts: dict | str, each: int, key: Column, seed: int = 11) -> DataFrame:
    """``rows`` with a column ``h``: of every label up to ``each`` rows, those of smallest hash of ``key``; rows of one key once.
    ``counts`` has the rows of each of a few labels, or names the column that has those of a row's label.

    A cut of the hashes that leaves more than ``each`` rows comes first, so that ranks are made over bounded rows only; of
    rows that share a hash the smallest stays, so reruns agree whatever the partitions."""
    wide = 1 << 30
    if isinstance(counts, str):
        cut = (wide * F.least(F.lit(1.0), (1.3 * each + 60) / F.col(counts))).cast("long")
    else:
        cut = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(wide * min(1.0, (1.3 * each + 60) / n))))]), F.col(label))
    h = F.xxhash64(F.lit(seed), key)
    near = rows.withColumn("h", h).filter(F.pmod("h", F.lit(wide)) < cut)
    others = [c for c in rows.columns if c != label]
    once = near.groupBy(label, "h").agg(F.min(F.struct(*others)).alias("r")).select(label, "h", "r.*")
    own = Window.partitionBy(label).orderBy(F.pmod("h", F.lit(wide)), "h")
    return once.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= each).drop("rank")


def fit_in_task(sample: DataFrame, learn: Callable[[list[tuple[str, object]]], dict[str, np.ndarray]], most_chars: int) -> dict[str, np.ndarray] | None:
    """``learn`` applied to the rows ``text, label, h`` of a bounded sample in one task of an executor, and what it learned;
    None for an empty sample. Rows come by label and hash; whole texts are taken up to ``most_chars`` characters a label,
    ones that do not fit are passed over. The task is a function of its rows, so one run again gives the same model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, room = [], {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                left = room.setdefault(label, most_chars) - len(text.as_py())
                if left >= 0:
                    room[label] = left
                    rows.append((text.as_py(), label))
        if rows:
            data = io.BytesIO()
            np.savez(data, **learn(rows))
            yield pa.record_batch([pa.array([data.getvalue()], pa.binary())], names=["model"])

    found = sample.select("text", "label", "h").repartition(1).sortWithinPartitions("label", "h").mapInArrow(run, "model binary").collect()
    if not found:
        return None
    with np.load(io.BytesIO(found[0][0])) as arrays:
        return dict(arrays)
