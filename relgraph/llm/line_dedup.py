"""Line dedup with levelled sorted runs of line hashes.

A :class:`LineRuns` store keeps, in the shared folder, runs of ``(hash, documents)``, each sorted by hash within range
partitions and written as Parquet. A batch of documents is aggregated to its line hashes, merge-anti-joined with the runs
as asked (keys that are already frequent need no more counting; or, for first-come dedup, keys seen before), and added as a
run of level 0. When a level has ``fanout`` runs they are merged into one of the next level, so there are O(log batches)
runs.

Lines are split, stripped, hashed and dropped in Arrow batches, vectorised over the bytes, in two scans of the texts. Keys that
are frequent are told from hashes of 128 bits. Up to ``BROADCAST_KEYS`` of them are broadcast and texts are never shuffled. Of
more, the hot ones (fewer than 1024 a part) are broadcast, and the others meet the documents that have them in a shuffle of
hashes, so a hot line never brings its documents to one task.

Defined results: a null or empty text is one empty line; a line that occurs several times in one document counts once for it;
rows that repeat a document are separate documents; dropping every line leaves an empty text; an empty table gives an empty
result; columns besides id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import HEAVY_PARTS, cut, ensure_checkpoint_dir, partitions, read
from .words import U, hash_runs, mix, slices, text_bytes

BLANK = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 3
#: Frequent keys (16 bytes each) up to which all are broadcast.
BROADCAST_KEYS = 500_000
RUN = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.LongType())])


_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of all texts: where each begins and ends, and its text. Every text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    each = 1 + np.diff(np.searchsorted(breaks, offsets))
    last = np.cumsum(each) - 1
    starts, ends = (np.empty(int(each.sum()), np.int64) for _ in range(2))
    inner = np.ones(len(starts), bool)
    inner[last - each + 1] = False
    starts[~inner], starts[inner] = offsets[:-1], breaks + 1
    inner[:], inner[last] = True, False
    ends[~inner], ends[inner] = offsets[1:], breaks
    return starts, ends, np.repeat(np.arange(len(each)), each)


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` and ``ends`` without blanks at both ends; lines with more than ``most`` of them are done one by one."""
    starts, ends = starts.copy(), ends.copy()
    left = right = np.arange(len(starts))
    for _ in range(most):
        left = left[starts[left] < ends[left]]
        left = left[_IS_BLANK[data[starts[left]]]]
        starts[left] += 1
    for _ in range(most):
        right = right[starts[right] < ends[right]]
        right = right[_IS_BLANK[data[ends[right] - 1]]]
        ends[right] -= 1
    for k in np.union1d(left, right).tolist():
        line = data[starts[k] : ends[k]].tobytes()
        starts[k] += len(line) - len(line.lstrip(BLANK))
        ends[k] = starts[k] + len(line.strip(BLANK))
    return starts, ends


def inside(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places are in one of the ranges, which do not overlap."""
    steps = np.zeros(size + 1, np.int8)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, ends, 1)
    return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each line's key (blanks stripped at both ends, A to Z lower-cased, nothing else changed), and whether it
    has ``min_chars`` code points."""
    starts, ends = stripped(data, starts, ends)
    own = _LOWER[data[inside(len(data), starts, ends)]]
    lengths = ends - starts
    packed = np.cumsum(lengths) - lengths
    counted = lengths >= min_chars
    if min_chars > 1:
        heads = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        counted = heads[packed + lengths] - heads[packed] >= min_chars
    return hash_runs(own, packed, lengths, 1), hash_runs(own, packed, lengths, 2), counted


def _keys(min_chars: int, each: bool):
    """Of a batch ``part, text``: ``part, h1, h2, n``, in how many documents of the part a key is; or with ``each`` (the first
    column then tells documents apart) its keys document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, offsets = text_bytes(batch.column(1).slice(a, b - a))
                starts, ends, doc = line_bounds(data, offsets)
                h1, h2, counted = line_hashes(data, starts, ends, min_chars)
                part = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                h1, h2, doc = h1[counted], h2[counted], doc[counted]
                group = doc if each else part[doc]
                order = np.lexsort((doc, group, h2, h1))
                h1, h2, doc, group = h1[order], h2[order], doc[order], group[order]
                same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (group[1:] == group[:-1])
                first = np.flatnonzero(np.append(True, ~same)[: len(h1)])
                fresh = np.append(True, ~(same & (doc[1:] == doc[:-1])))[: len(h1)]  # of a document, a key counts once
                n = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else first
                yield pa.record_batch([pa.array(part[doc[first]]), pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), pa.array(n)], names=["part", "h1", "h2", "n"])

    return run


def found_in(table: tuple[np.ndarray, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which pairs are in ``table``, pairs sorted."""
    at, out = np.searchsorted(table[0], h1), np.zeros(len(h1), bool)
    open_ = np.flatnonzero(at < len(table[0]))
    while len(open_):  # once, unless pairs of the table share their first half
        open_ = open_[table[0][at[open_]] == h1[open_]]
        out[open_] |= table[1][at[open_]] == h2[open_]
        at[open_] += 1
        open_ = open_[at[open_] < len(table[0])]
    return out


def without(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The texts of the ``kept`` lines, joined by newlines: each line goes with the newline before it but for a text's first."""
    starts, ends, doc = starts[kept], ends[kept], doc[kept]
    starts = starts - np.append(False, doc[1:] == doc[:-1])[: len(doc)]
    sizes = np.bincount(doc, ends - starts, len(offsets) - 1).astype(np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(places.tobytes()), pa.py_buffer(data[inside(len(data), starts, ends)].tobytes()))


def _drop(shared, min_chars: int):
    """``doc_id, text`` and perhaps ``hot`` (the document's own frequent keys) to ``doc_id, n_lines, n_dropped, kept_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, offsets = text_bytes(batch.column(1).slice(a, b - a))
                starts, ends, doc = line_bounds(data, offsets)
                h1, h2, counted = line_hashes(data, starts, ends, min_chars)
                hot = found_in(table, h1, h2)
                if batch.num_columns > 2:
                    own = batch.column(2).slice(a, b - a)
                    of = np.repeat(np.arange(b - a), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                    k1, k2 = (own.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for k in (0, 1))
                    k1 = mix(k1 ^ mix(of.astype(U)))
                    order = np.lexsort((k2, k1))
                    hot |= found_in((k1[order], k2[order]), mix(h1 ^ mix(doc.astype(U))), h2)
                hot &= counted
                n, dropped = np.bincount(doc, minlength=b - a), np.bincount(doc[hot], minlength=b - a)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), without(data, offsets, starts, ends, doc, ~hot)], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


class LineRuns:
    """Levelled sorted runs of line hashes with document counts."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{ensure_checkpoint_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        to = f"{self.path}/level-{level}-{uuid.uuid4().hex}"
        counts.repartitionByRange(partitions(self.spark), "h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(to)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(to)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._sum(merged), level + 1)
            self._delete(merged)

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark._jvm
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _sum(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """``h1, h2, n`` over all runs."""
        paths = [p for level in self.levels for p in level]
        return self._sum(paths) if paths else self.spark.createDataFrame([], RUN)

    def add(self, keys: DataFrame, saturated: int | None = None) -> None:
        """Add a batch ``h1, h2, n`` (documents that have the key, in any number of rows a key). With ``saturated``, keys that
        the runs already count that often are left out: their verdict is known."""
        batch = keys.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        if saturated is not None and any(self.levels):
            batch = batch.hint("merge").join(self.counts().filter(F.col("n") >= saturated), ["h1", "h2"], "left_anti")
        self._write(batch, 0)

    def add_new(self, keys: DataFrame) -> DataFrame:
        """First-come dedup: the keys of the batch that no run has, which are then added as a run of their own."""
        batch = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        fresh = cut(batch.hint("merge").join(self.counts(), ["h1", "h2"], "left_anti") if any(self.levels) else batch)
        self._write(fresh, 0)
        return fresh.select("h1", "h2")

    def close(self) -> None:
        self._delete([self.path])
        self.levels = []


def frequent_keys(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The keys of at least ``min_chars`` code points found in at least ``min_docs`` documents, as ``h1, h2``, and the hot ones
    among them: fewer than ``batches * HEAVY_PARTS``, with all that more than about one in ``HEAVY_PARTS`` of the (document,
    key) pairs have. Documents are dealt to the runs in ``batches`` parts of one size; every document is in one of them."""
    spark, runs = docs.sparkSession, LineRuns(docs.sparkSession, fanout=fanout)
    part = F.pmod(F.monotonically_increasing_id(), F.lit(batches)).cast("int")
    keys = docs.select(part.alias("part"), F.col(text_col).alias("text")).mapInArrow(_keys(min_chars, False), "part int, h1 long, h2 long, n long")
    # hashes of all batches are made in one scan of the texts and kept, narrow, in the shared folder
    held = f"{runs.path}/batches"
    keys.write.partitionBy("part").parquet(held)
    rows = spark.read.schema(T.StructType([*RUN.fields, T.StructField("part", T.IntegerType())])).parquet(held)
    pairs = rows.agg(F.sum("n")).first()[0] or 0
    for k in range(batches):
        runs.add(rows.filter(F.col("part") == k).drop("part"), saturated=min_docs)
    found = cut(runs.counts().filter(F.col("n") >= min_docs))
    runs.close()
    # the runs count a key until its verdict is known, so at least over the first part that has it: about 1 / batches of all
    return found.select("h1", "h2"), found.filter(F.col("n") > pairs / (batches * HEAVY_PARTS)).select("h1", "h2")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text``: one row for each row of ``docs``, its lines with a frequent key dropped and
    the others joined by newlines, in order."""
    found, hot = frequent_keys(docs, text_col, min_docs, min_chars, batches)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared, rare = found, None
    if found.count() > broadcast_keys:
        hashed = rows.select(F.xxhash64("doc_id", "text").alias("part"), "text").mapInArrow(_keys(min_chars, True), "part long, h1 long, h2 long, n long")
        shared = hot
        rare = hashed.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(found.hint("merge"), ["h1", "h2"], "left_semi").select(F.col("part").alias("uid"), "h1", "h2")
    table = shared.toArrow()
    pairs = [table.column(k).to_numpy().view(U) for k in (0, 1)]
    order = np.lexsort((pairs[1], pairs[0]))
    keys = docs.sparkSession.sparkContext.broadcast((pairs[0][order], pairs[1][order]))
    if rare is not None:
        # rows that share a uid share a set of frequent keys, which says of any line the same as each one's own set would
        hits = rare.groupBy("uid").agg(F.collect_set(F.struct("h1", "h2")).alias("hot"))
        rows = rows.withColumn("uid", F.xxhash64("doc_id", "text")).join(hits, "uid", "left").select("doc_id", "text", "hot")
    return rows.mapInArrow(_drop(keys, min_chars), f"doc_id {dict(docs.dtypes)[id_col]}, n_lines long, n_dropped long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (
  select doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null as hot from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (hot) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not hot), '')) as kept_sha256
from m group by doc_id
"""
