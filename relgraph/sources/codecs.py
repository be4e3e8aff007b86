"""Edge-list formats: text, packed adjacency, split node and edge files, neighbour lists, Parquet.

A binary file is one task's work, read in stretches where ``pyarrow.fs`` can open it and else whole by ``binaryFile``, so large
graphs should be kept in many part files (paths, lists and globs are taken) or, better, in Parquet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:
    import pandas as pd

EDGES = "src long, dst long"


def _records(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Little-endian int32 records ``vertex, degree, degree x target`` as vertices, degrees and all targets."""
    words = np.frombuffer(data, "<i4")
    starts, at = [], 0
    while at < len(words):
        starts.append(at)
        at += 2 + int(words[at + 1])
    if at > len(words):
        raise ValueError("the last adjacency record is cut off")
    heads = np.array(starts, np.int64)
    keep = np.ones(len(words), bool)
    keep[heads] = keep[heads + 1] = False
    return words[heads].astype(np.int64), words[heads + 1].astype(np.int64), words[keep].astype(np.int64)


def decode_packed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Packed records (see :func:`_records`) to two columns."""
    ids, degrees, targets = _records(data)
    return np.repeat(ids, degrees), targets


def _ids(values: np.ndarray | list) -> np.ndarray:
    """Ids as the formats' int32; ids beyond that raise."""
    wide = np.asarray(values, np.int64)
    if len(wide) and (int(wide.min()) < -(1 << 31) or int(wide.max()) >= 1 << 31):
        raise ValueError("ids of binary graph files are 32 bits wide; rename vertices first (see prep.dense_names)")
    return wide.astype("<i4")


def encode_packed(src: np.ndarray, lists: list[np.ndarray]) -> bytes:
    parts = []
    for v, targets in zip(src, lists, strict=True):
        parts += [_ids([v, len(targets)]), _ids(targets)]
    return np.concatenate(parts).tobytes() if parts else b""


def _binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def _streamed(spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    """The files' paths, where ``pyarrow.fs`` can open them in tasks; None where only Spark can."""
    from pyarrow import fs

    files = _binary(spark, paths).select("path")
    first = files.first()
    try:
        return files if first is None or fs.FileSystem.from_uri(first.path) else None
    except (pa.ArrowException, OSError, ValueError, ImportError):
        return None


def read_packed(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Packed adjacency files as edges; ``limit`` edges exactly where given. Files are read in stretches; what only Spark can
    open is held whole, a file a row."""
    from . import graph_files

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with graph_files._open(path) as stream:
                    for ids, counts, _, targets in graph_files._records(stream):
                        yield pa.record_batch([pa.array(np.repeat(ids, counts)), pa.array(targets)], names=["src", "dst"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for f in frames:
            for content in f["content"]:
                src, dst = decode_packed(content)
                yield pd.DataFrame({"src": src, "dst": dst})

    files = _streamed(spark, paths)
    e = _binary(spark, paths).select("content").mapInPandas(run, EDGES) if files is None else files.mapInArrow(stretches, EDGES)
    return e if limit is None else e.limit(limit)


def read_packed_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Packed adjacency files as ``key, vs``, a row a record: the lists are taken as they are, read as by :func:`read_packed`."""
    from . import graph_files

    def lists(ids: np.ndarray, degrees: np.ndarray, targets: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(degrees)]).astype(np.int32)
        return pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(targets))], names=["key", "vs"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                begin, vertex, held = -1, 0, []  # the record that may go on
                with graph_files._open(path) as stream:
                    for ids, counts, begins, targets in graph_files._records(stream):
                        if not len(ids):
                            continue
                        if begin == begins[0]:
                            held.append(targets[: counts[0]])
                            ids, counts, begins, targets = ids[1:], counts[1:], begins[1:], targets[counts[0] :]
                        if len(ids):
                            if begin >= 0:
                                yield lists(np.array([vertex]), np.array([sum(map(len, held))]), np.concatenate(held))
                            split = len(targets) - int(counts[-1])
                            yield lists(ids[:-1], counts[:-1], targets[:split])
                            begin, vertex, held = int(begins[-1]), int(ids[-1]), [targets[split:]]
                if begin >= 0:
                    yield lists(np.array([vertex]), np.array([sum(map(len, held))]), np.concatenate(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield lists(*_records(content))

    files, schema = _streamed(spark, paths), "key long, vs array<long>"
    return _binary(spark, paths).select("content").mapInArrow(run, schema) if files is None else files.mapInArrow(stretches, schema)


def write_packed(e: DataFrame, path: str) -> None:
    """Packed adjacency of all sources, as rows ``content`` of a Parquet table: each is what one packed file would hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"content": [encode_packed(f["src"].to_numpy(), list(f["neighbours"]))]})

    lists = e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    lists.mapInPandas(run, "content binary").write.parquet(path)


def read_packed_rows(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_packed` wrote."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for f in frames:
            for content in f["content"]:
                src, dst = decode_packed(content)
                yield pd.DataFrame({"src": src, "dst": dst})

    return spark.read.parquet(path).mapInPandas(run, EDGES)


def write_binary(e: DataFrame, uri: str, parts: int, split: bool = False) -> list[str]:
    """``e`` as ``parts`` binary files, vertex v in part ``v % parts``, sorted: ``part-I`` in the packed form, or with ``split``
    ``part-I-nodes`` and ``part-I-edges``. Returns the paths, with ``split`` the prefixes, as the readers take them.

    ``uri`` is a folder that all executors can write to by ``pyarrow.fs`` (a shared ``file:`` folder, HDFS, an object store). A
    task writes to names of its own and the driver renames those of the attempt that was counted, so a lost executor leaves
    only files that nothing names. A task holds a batch of edges, however many a vertex or a part has."""
    from .graph_files import write_packed_files, write_split_parts

    if split:
        return sorted(write_split_parts(e, uri, F.pmod("src", F.lit(parts)), parts).values())
    return write_packed_files(e, uri, parts, index=False)


def decode_nodes(nodes: bytes, cumulative: bool = False, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and degrees of a node file, in either form (see :func:`decode_split`)."""
    head = np.frombuffer(nodes, "<i4").astype(np.int64)
    if cumulative:
        return part + parts * np.arange(len(head), dtype=np.int64), np.diff(head, prepend=0)
    return head[0::2], head[1::2]


def decode_split(nodes: bytes, targets: bytes, cumulative: bool = False, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Split files to two columns. ``nodes`` holds ``vertex, degree`` pairs, or with ``cumulative`` each vertex's end offset,
    the i-th vertex being ``part + i * parts``."""
    dst = np.frombuffer(targets, "<i4").astype(np.int64)
    ids, degrees = decode_nodes(nodes, cumulative, part, parts)
    if degrees.sum() != len(dst):
        raise ValueError(f"{degrees.sum()} edges named, {len(dst)} found")
    return np.repeat(ids, degrees), dst


def encode_split(src: np.ndarray, lists: list[np.ndarray]) -> tuple[bytes, bytes]:
    heads = _ids([x for v, own in zip(src, lists, strict=True) for x in (v, len(own))])
    return heads.tobytes(), _ids(np.concatenate(lists) if lists else []).tobytes()


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file sources name it, with scheme and host, and as the one without an authority where it has none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _places(spark: SparkSession, prefixes: list[str]) -> Callable[[str], int]:
    """The place in ``prefixes`` of a prefix as Spark names it."""
    same = lambda p: re.sub("^file:/+", "file:/", p)  # noqa: E731  (written with one slash or three)
    found = {same(_qualified(spark, p)): i for i, p in enumerate(prefixes)}
    return lambda prefix: found[same(prefix)]


def read_split_degrees(spark: SparkSession, prefixes: list[str], cumulative: bool = False) -> DataFrame:
    """``v, degree`` of a split graph (see :func:`read_split`) from its node files alone."""
    place, parts = _places(spark, prefixes), len(prefixes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for f in frames:
            for prefix, nodes in zip(f["prefix"], f["content"], strict=True):
                ids, degrees = decode_nodes(nodes, cumulative, place(prefix), parts)
                yield pd.DataFrame({"v": ids, "degree": degrees})

    files = _binary(spark, [f"{p}-nodes" for p in prefixes])
    return files.select(F.regexp_replace("path", "-nodes$", "").alias("prefix"), "content").mapInPandas(run, "v long, degree long")


def read_split(spark: SparkSession, prefixes: list[str], cumulative: bool = False) -> DataFrame:
    """Graphs kept as ``PREFIX-nodes`` and ``PREFIX-edges``; with ``cumulative`` the prefixes are parts 0, 1, ... of the graph.
    Pairs of files are read in stretches, but for cumulative ones and those that only Spark can open."""
    from . import graph_files

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                prefix, found = path.removesuffix("-edges"), size // 4
                named = sum(int(heads[:, 1].sum()) for _, heads in graph_files._heads(prefix, "split"))
                if named != found:
                    raise ValueError(f"{named} edges named, {found} found")
                if found:
                    yield from graph_files.read_cut(graph_files.Cut(prefix, end=found), "split")

    edges = [f"{p}-edges" for p in prefixes]
    if not cumulative and _streamed(spark, edges) is not None:
        return _binary(spark, edges).select("path", "length").mapInArrow(stretches, EDGES)
    files = _binary(spark, [f"{p}-{kind}" for p in prefixes for kind in ("nodes", "edges")])
    pairs = files.select(F.regexp_replace("path", "-(nodes|edges)$", "").alias("prefix"), F.regexp_extract("path", "-(nodes|edges)$", 1).alias("kind"), "content")
    both = pairs.groupBy("prefix").agg(F.max(F.when(F.col("kind") == "nodes", F.col("content"))).alias("nodes"), F.max(F.when(F.col("kind") == "edges", F.col("content"))).alias("edges"))
    place, parts = _places(spark, prefixes), len(prefixes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for f in frames:
            for prefix, nodes, edges in zip(f["prefix"], f["nodes"], f["edges"], strict=True):
                src, dst = decode_split(nodes, edges, cumulative, place(prefix), parts)
                yield pd.DataFrame({"src": src, "dst": dst})

    return both.mapInPandas(run, EDGES)


def _without_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``value, path, start`` without the first one of each file: a file's blocks are read in order of lines, and its
    first line is the first of the block that begins at 0."""
    seen = set()
    for batch in batches:
        keep = np.ones(len(batch), bool)
        heads = np.flatnonzero(batch.column(2).to_numpy() == 0)
        paths = batch.column(1).take(pa.array(heads)).dictionary_encode()
        values, first = np.unique(paths.indices.to_numpy(), return_index=True)
        for path, k in zip(paths.dictionary.take(pa.array(values)).to_pylist(), first, strict=True):
            if path not in seen:
                seen.add(path)
                keep[heads[k]] = False
        yield pa.record_batch([batch.column(0).filter(pa.array(keep))], names=["value"])


def read_text(spark: SparkSession, paths: str | list[str], comment: str = "#", strict: bool = True, skip_first: bool = False) -> DataFrame:
    """A pair of ids a line, parted by white space; lines that begin with ``comment`` are skipped. Unreadable lines go, or
    with ``strict=False`` give 0 for what can't be read. ``skip_first`` drops each file's first line."""
    lines = spark.read.text(paths)
    if skip_first:
        lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).mapInArrow(_without_first, "value string")
    lines = lines.filter(~F.startswith("value", F.lit(comment)) & (F.trim("value") != ""))
    words = F.split(F.trim("value"), r"\s+")
    ids = lines.select(words.alias("w")).selectExpr("try_cast(try_element_at(w, 1) as bigint) as src", "try_cast(try_element_at(w, 2) as bigint) as dst")
    return ids.filter("src is not null and dst is not null") if strict else ids.select(F.coalesce("src", F.lit(0)).cast("long").alias("src"), F.coalesce("dst", F.lit(0)).cast("long").alias("dst"))


def write_text(e: DataFrame, path: str) -> None:
    e.select(F.concat_ws("\t", "src", "dst").alias("value")).write.text(path)


def convert_text(spark: SparkSession, paths: str | list[str], uri: str, parts: int, split: bool = False, skip_first: bool = False) -> list[str]:
    """Text edges (see :func:`read_text`) as binary adjacency files (see :func:`write_binary`), a source's edges together
    wherever they stand in the text. Returns the files' paths."""
    return write_binary(read_text(spark, paths, skip_first=skip_first), uri, parts, split)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``value, path, start`` with ``k``, their number in the file's block; a task reads a block's lines together, in
    order."""
    last, seen = None, 0
    for batch in batches:
        if not len(batch):
            continue
        path, start = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        code = path.indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (start[1:] != start[:-1])]))
        k = np.arange(len(batch)) - np.repeat(heads, np.diff(np.append(heads, len(batch))))
        block = lambda i: (path.dictionary[int(code[i])].as_py(), int(start[i]))  # noqa: B023, E731
        if block(0) == last:
            k[: heads[1] if len(heads) > 1 else len(batch)] += seen
        last, seen = block(-1), int(k[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(k)], names=["value", "path", "start", "k"])


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value, path, line``: lines with their number in the file, from 0, by counts of each of its blocks; so a file is read
    by as many tasks as it has blocks."""
    read = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = read.mapInArrow(_numbered, "value string, path string, start long, k long")
    blocks = lines.groupBy("path", "start").agg((F.max("k") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("path", "start", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(starts, ["path", "start"]).select("value", "path", (F.col("before") + F.col("k")).alias("line"))


def read_neighbour_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Line 1: ``nodes edges``; line i after it: the neighbours of vertex i, blank for none."""
    rows = numbered_lines(spark, paths).filter("line > 0")
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return rows.select(F.col("line").alias("src"), F.explode(words).alias("dst")).select("src", F.col("dst").cast("long").alias("dst"))


def write_partitioned(e: DataFrame, path: str, part: Column) -> None:
    """Edges as Parquet in one folder for each value of ``part``; a part without edges has none."""
    e.withColumn("part", part).write.partitionBy("part").parquet(path)
