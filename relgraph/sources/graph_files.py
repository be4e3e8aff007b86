"""Graphs in binary files as a Spark data source, ``edges``: a file is read by many tasks, in chunks of bounded memory.

Layouts: ``split`` (``PREFIX-nodes`` with pairs vertex, degree; ``PREFIX-edges`` with all targets), ``hilbert`` (blocks of 2^16 by
2^16 cells along the curve: ``PREFIX-upper`` with x >> 16, y >> 16 and the number of edges, ``PREFIX-lower`` with an edge's low
16 bits each, the source in the low half), ``prefix`` (four nested levels, see :func:`encode_prefixes`; ids beyond 32 bits have
``PREFIX-pages`` above them, with x >> 32, y >> 32 and the number of records of the first level) and ``packed`` (one file of records
vertex, degree, targets). All numbers are little-endian. Ids of ``hilbert`` files are below 2^48, of ``prefix`` files below 2^63; along
the curve go the squares of 2^31 by 2^31 cells, one after the other. The first two are cut at every ``edges`` edges, hubs and full
blocks too: cut points come from one pass over the node or block file, of which only they are kept. Packed files are cut in the
same way where their index says (see :func:`index_packed`). A scan of a range of ``src`` or ``dst`` reads only the cuts that have
such a vertex or block.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import hilbert
from .codecs import _ids

EDGES = "src long, dst long"
#: Edges that a partition of a file has, and that are held at a time.
PART_EDGES, CHUNK = 1 << 22, 1 << 20
WIDTH = {"split": 2, "hilbert": 3}
HEAD = {"split": "-nodes", "hilbert": "-upper"}
BODY = {"split": "-edges", "hilbert": "-lower"}


def _open(path: str, at: int = 0):
    store, name = fs.FileSystem.from_uri(path)
    stream = store.open_input_file(name)
    stream.seek(at)
    return stream


def _heads(path: str, layout: str, at: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Records of a node or block file from the ``at``-th on, some at a time, each time with the first one's number."""
    width = WIDTH[layout]
    with _open(path + HEAD[layout], 4 * width * at) as stream:
        while data := stream.read(4 * width * CHUNK):
            yield at, np.frombuffer(data, "<i4" if layout == "split" else "<u4").reshape(-1, width).astype(np.int64)
            at += len(data) // (4 * width)


@dataclass
class Cut(InputPartition):
    """Edges ``start`` to ``end`` of a file; the first is of record ``head``, which begins at edge ``head_start``."""

    path: str
    head: int = 0
    head_start: int = 0
    start: int = 0
    end: int = 0


def cuts(path: str, layout: str, edges: int, wanted: dict[str, tuple[int, int]]) -> list[Cut]:
    """A file's ranges of up to ``edges`` edges, without those in which no record can have a ``wanted`` end."""
    out, total = [], 0
    reach: list[bool] = []
    for first, heads in _heads(path, layout):
        ends = total + np.cumsum(heads[:, -1])
        starts = ends - heads[:, -1]
        if layout == "split":
            keep = (heads[:, 0] >= wanted["src"][0]) & (heads[:, 0] <= wanted["src"][1])
        else:
            keep = np.ones(len(heads), bool)
            for k, end in enumerate(("src", "dst")):
                keep &= ((heads[:, k] + 1 << 16) > wanted[end][0]) & (heads[:, k] << 16 <= wanted[end][1])
        last = int(ends[-1]) if len(ends) else total
        for p in range(len(out), -(-last // edges)):  # cut points that fall into this stretch of records
            k = int(np.searchsorted(ends, p * edges, "right"))
            out.append(Cut(path, first + k, int(starts[k]), p * edges, 0))
            reach.append(False)
        for p in np.unique(np.concatenate([_parts(starts[keep], ends[keep], edges)])).tolist() if keep.any() else []:
            reach[p] = True
        total = last
    for cut in out:
        cut.end = min(cut.start + edges, total)
    return [c for c, r in zip(out, reach, strict=True) if r]


def _parts(starts: np.ndarray, ends: np.ndarray, edges: int) -> np.ndarray:
    """The ranges that records reach into; records without edges reach none."""
    some = ends > starts
    first, last = starts[some] // edges, (ends[some] - 1) // edges
    n = last - first + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def read_cut(cut: Cut, layout: str) -> Iterator[pa.RecordBatch]:
    body = _open(cut.path + BODY[layout], 4 * cut.start)
    at, head_start = cut.start, cut.head_start
    with body:
        for _, heads in _heads(cut.path, layout, cut.head):
            ends = head_start + np.cumsum(heads[:, -1])
            while at < min(cut.end, int(ends[-1])):
                n = min(CHUNK, min(cut.end, int(ends[-1])) - at)
                data = np.frombuffer(body.read(4 * n), "<i4" if layout == "split" else "<u4").astype(np.int64)
                if len(data) < n:
                    raise ValueError(f"{cut.path}: {cut.end} edges named, {at + len(data)} found")
                record = np.searchsorted(ends, np.arange(at, at + n), "right")
                if layout == "split":
                    src, dst = heads[record, 0], data
                else:
                    src, dst = heads[record, 0] << 16 | data & 0xFFFF, heads[record, 1] << 16 | data >> 16
                yield pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])
                at += n
            head_start = int(ends[-1])
            if at >= cut.end:
                return


# --- packed adjacency --------------------------------------------------------------------------------------------------


def _records(stream, at: int = 0, vertex: int = 0, left: int = 0, head: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A stretch of a packed file at a time, from byte ``at`` on: vertices, how many targets each has in the stretch, where its
    record begins, and the targets. A record may go on in the next stretch; ``left`` targets of ``vertex`` come first."""
    half = b""
    while data := stream.read(4 * CHUNK):
        words = np.frombuffer(half + data, "<i4")
        base, k = at - len(half), 0
        at += len(data)
        ids, counts, begins, keep = [], [], [], np.ones(len(words), bool)
        while left or k + 1 < len(words):
            if not left:
                vertex, left, head = int(words[k]), int(words[k + 1]), base + 4 * k
                if left < 0:
                    raise ValueError(f"a degree of {left} at byte {head}")
                keep[k : k + 2] = False
                k += 2
            n = min(left, len(words) - k)
            ids.append(vertex)
            counts.append(n)
            begins.append(head)
            left, k = left - n, k + n
            if left:
                break
        half = words[k:].tobytes()
        keep[k:] = False
        yield np.array(ids, np.int64), np.array(counts, np.int64), np.array(begins, np.int64), words[keep].astype(np.int64)
    if left or half:
        raise ValueError("the last adjacency record is cut off")


def _index_path(path: str) -> str:
    """Beside the file, under a name that Spark's file sources pass over."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/_{name}-index"


def packed_index(path: str, edges: int) -> np.ndarray:
    """A row for every ``edges`` edges of a packed file: the byte at which its first edge's record begins, the number of that
    record's first edge, its own first edge and its end, and the least and the greatest vertex."""
    found: dict[int, list[int]] = {}
    total, head, head_start = 0, -1, 0
    with _open(path) as stream:
        for ids, counts, begins, _ in _records(stream):
            for v, n, begin in zip(ids.tolist(), counts.tolist(), begins.tolist(), strict=True):
                if begin != head:
                    head, head_start = begin, total
                for p in range(total // edges, -(-(total + n) // edges)) if n else ():
                    row = found.setdefault(p, [head, head_start, p * edges, 0, v, v])
                    row[3:] = [min((p + 1) * edges, total + n), min(row[4], v), max(row[5], v)]
                total += n
    return np.array(list(found.values()), "<i8").reshape(-1, 6)


def index_packed(spark: SparkSession, paths: list[str], edges: int = PART_EDGES) -> list[str]:
    """Writes the index of each packed file beside it, in one pass, a file a task and some of it at a time; gives ``paths`` back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(_index_path(path))
                rows = packed_index(path, edges)
                own = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as stream:
                    stream.write(rows.tobytes())
                store.move(own, name)
                yield pa.record_batch([pa.array([len(rows)], pa.int64())], names=["cuts"])

    if paths:
        files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
        files.mapInArrow(run, "cuts long").agg(F.sum("cuts")).collect()
    return paths


def packed_cuts(path: str, wanted: dict[str, tuple[int, int]]) -> list[Cut]:
    """The ranges of a packed file's index that have a vertex within ``wanted``."""
    with _open(_index_path(path)) as stream:
        rows = np.frombuffer(stream.read(), "<i8").reshape(-1, 6)
    rows = rows[(rows[:, 5] >= wanted["src"][0]) & (rows[:, 4] <= wanted["src"][1])]
    return [Cut(path, *r) for r in rows[:, :4].tolist()]


def read_packed_cut(cut: Cut) -> Iterator[pa.RecordBatch]:
    """A range's edges. It begins inside its first record, whose earlier targets are not read."""
    with _open(cut.path, cut.head) as stream:
        vertex, degree = np.frombuffer(stream.read(8), "<i4").tolist()
        at = cut.head + 8 + 4 * (cut.start - cut.head_start)
        stream.seek(at)
        total = cut.start
        for ids, counts, _, targets in _records(stream, at, vertex, degree - (cut.start - cut.head_start), cut.head):
            n = min(len(targets), cut.end - total)
            yield pa.record_batch([pa.array(np.repeat(ids, counts)[:n]), pa.array(targets[:n])], names=["src", "dst"])
            total += n
            if total == cut.end:
                return
    raise ValueError(f"{cut.path}: {cut.end} edges named, {total} found")


def _ranged(placed: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """``placed`` sorted by part, source and target over many tasks: as many as the session shuffles to, and ``tasks`` at least."""
    n = max(tasks, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(n, "part", "src", "dst").sortWithinPartitions("part", "src", "dst").select(*columns)


def _segments(sorted_rows: DataFrame, uri: str, kinds: tuple[str, ...], write) -> dict[int, list]:
    """Each task's stretch of each part as files of its own, by ``write(streams, columns)`` for every batch's rows of a part. Gives a
    part's stretches in order: name, first vertex, its degree, last vertex, its number of edges in the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, root = fs.FileSystem.from_uri(uri)
        task = TaskContext.get().partitionId()
        found: dict[int, list] = {}
        streams: dict = {}
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            p = columns[0]
            for own in np.split(np.arange(len(p)), np.flatnonzero(p[1:] != p[:-1]) + 1) if len(p) else []:
                here, rows = int(p[own[0]]), [c[own] for c in columns[1:]]
                if here not in found:
                    for stream in streams.values():
                        stream.close()
                    name = f"{root}/.{uuid.uuid4().hex}"
                    streams = {k: out.open_output_stream(name + k) for k in kinds}
                    found[here] = [name, int(rows[0][0]), int(rows[0][0]), 0]
                write(streams, rows, found[here])
        for stream in streams.values():
            stream.close()
        for part, (name, first, last, n) in found.items():
            yield pa.record_batch([pa.array([x]) for x in (task, part, name, first, last, n)], names=["task", "part", "name", "first", "last", "n"])

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root)
    rows = sorted_rows.mapInArrow(run, "task long, part long, name string, first long, last long, n long").collect()  # a row a file
    parts: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.part, r.task)):
        parts.setdefault(r.part, []).append(r)
    return parts


def _joined(spark: SparkSession, uri: str, files: dict[str, list]) -> None:
    """Writes each file from its pieces, a file a task, copying some of it at a time: records ``vertex, number`` and stretches
    ``name, more``, to whose first record's number ``more`` is added. The stretches go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for to, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(uri)
                own = f"{to}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    for piece in json.loads(pieces):
                        if not isinstance(piece[0], str):
                            out.write(_ids(piece).tobytes())
                            continue
                        with store.open_input_file(piece[0]) as stream:
                            if piece[1]:
                                out.write(_ids(np.frombuffer(stream.read(8), "<i4") + np.array([0, piece[1]])).tobytes())
                            while data := stream.read(4 * CHUNK):
                                out.write(data)
                store.move(own, to)
                yield pa.record_batch([pa.array([1], pa.int64())], names=["files"])

    if files:
        rows = spark.createDataFrame([(to, json.dumps(pieces)) for to, pieces in files.items()], "to string, pieces string")
        rows.repartition(len(files)).mapInArrow(run, "files long").agg(F.sum("files")).collect()
        store, _ = fs.FileSystem.from_uri(uri)
        for pieces in files.values():
            for piece in pieces:
                if isinstance(piece[0], str):
                    store.delete_file(piece[0])


def write_packed_files(e: DataFrame, uri: str, parts: int, edges: int = PART_EDGES, index: bool = True) -> list[str]:
    """Packed files, vertex v in part ``v % parts``, sorted, and unless told otherwise their indices. Degrees are joined to the edges, so that a record's
    head is known before its targets. A part is sorted by many tasks, hubs too, and its stretches are then copied together."""

    def write(streams: dict, rows: list[np.ndarray], state: list) -> None:
        src, degree, dst = rows
        # a stretch's first vertex has its head, if it is due, between the stretches
        fresh = np.append(state[2] != int(src[0]), src[1:] != src[:-1])
        if not state[3]:
            state[3] = int(degree[0])
        heads = np.stack([src[fresh], degree[fresh]], 1).ravel()
        streams[""].write(_ids(np.insert(dst, np.repeat(np.flatnonzero(fresh), 2), heads)).tobytes())
        state[2] = int(src[-1])

    degrees = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    rows = e.select("src", "dst").join(degrees, "src").select(F.pmod("src", F.lit(parts)).cast("long").alias("part"), "src", "degree", "dst")
    found = _segments(_ranged(rows, parts, "part", "src", "degree", "dst"), uri, ("",), write)
    _, root = fs.FileSystem.from_uri(uri)
    files = {}
    for part, own in found.items():
        last, pieces = None, []
        for r in own:
            pieces += [[r.name, 0]] if r.first == last else [[r.first, r.n], [r.name, 0]]
            last = r.last
        files[f"{root}/part-{part}"] = pieces
    _joined(e.sparkSession, uri, files)
    paths = sorted(f"{uri}/part-{part}" for part in found)
    return index_packed(e.sparkSession, paths, edges) if index else paths


class EdgeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.layout = options.get("layout", "split")
        self.paths = json.loads(options["paths"])
        self.edges = int(options.get("edges", PART_EDGES))
        self.wanted = {end: tuple(json.loads(options.get(end, "null")) or (-(1 << 63), (1 << 63) - 1)) for end in ("src", "dst")}

    def partitions(self) -> list[InputPartition]:
        if self.layout == "prefix":
            return [Cut(p) for p in self.paths] or [Cut("")]
        if self.layout == "packed":
            return [c for p in self.paths for c in packed_cuts(p, self.wanted)] or [Cut("")]
        return [c for p in self.paths for c in cuts(p, self.layout, self.edges, self.wanted)] or [Cut("")]

    def read(self, partition: Cut) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return iter(())
        if self.layout == "packed":
            return read_packed_cut(partition)
        return read_prefixes(partition.path) if self.layout == "prefix" else read_cut(partition, self.layout)


class EdgeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edges"

    def schema(self) -> str:
        return EDGES

    def reader(self, schema) -> EdgeReader:
        return EdgeReader(dict(self.options))


def read_edges(spark: SparkSession, paths: list[str], layout: str, edges: int = PART_EDGES, src: tuple[int, int] | None = None, dst: tuple[int, int] | None = None) -> DataFrame:
    """``src, dst`` of files kept as ``PATH-...``, all or with either end in a range, both bounds included. Packed files need an
    index, which sets their cuts in place of ``edges``; a range of ``dst`` filters them only.

    Ranges are options of the scan, not filters that Spark pushes down: Spark keeps what a Python source planned for the first
    filter and reads the same DataFrame by it again under another one."""
    spark.dataSource.register(EdgeFiles)
    read = spark.read.format("edges").option("layout", layout).option("paths", json.dumps(paths)).option("edges", edges)
    for end, within in (("src", src), ("dst", dst)):
        read = read if within is None else read.option(end, json.dumps(list(within)))
    e = read.load()
    for end, within in (("src", src), ("dst", dst)):
        e = e if within is None else e.filter(F.col(end).between(*within))
    return e


# --- writing along the curve -------------------------------------------------------------------------------------------


def _along_curve(e: DataFrame, parts: int, bits: int) -> DataFrame:
    """Edges with ids of up to ``bits`` bits, range-partitioned and sorted along the curve, whose keys have 31 bits of either id: squares
    of as many cells follow one another."""
    fits = F.least("src", "dst") >= 0
    fits = fits if bits == 63 else fits & (F.greatest("src", "dst") < 1 << bits)
    own = [F.when(fits, F.col(c)).otherwise(F.raise_error(F.lit(f"ids must be from 0 to 2^{bits} - 1"))).cast("long").alias(c) for c in ("src", "dst")]
    rest = [F.col(c).bitwiseAND((1 << 31) - 1).alias(f"__{c}") for c in ("src", "dst")]
    keyed = hilbert.with_key(e.select(*own).select("src", "dst", *rest), "__src", "__dst")
    order = [F.shiftright(c, low) for low in (32, 31) for c in ("src", "dst")]
    return keyed.drop("__src", "__dst").repartitionByRange(parts, *order, "hilbert_key").sortWithinPartitions(*order, "hilbert_key")


def _written(laid: DataFrame, uri: str, write, kinds: tuple[str, ...]) -> list[str]:
    """A file set for each partition of ``laid``, by ``write(batches, streams)``, which gives the number of edges. A task writes
    to names of its own and the driver renames those of the attempt that was counted. Files of pages without any go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, root = fs.FileSystem.from_uri(uri)
        name = f"{root}/.{uuid.uuid4().hex}"
        streams = {k: out.open_output_stream(name + k) for k in kinds}
        n = write(batches, streams)
        kept = [k for k in kinds if n and (k != PAGES or streams[k].tell())]
        for k, stream in streams.items():
            stream.close()
            if k not in kept:
                out.delete_file(name + k)
        if n:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([kept])], names=["part", "name", "kinds"])

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root)
    paths = []
    for r in laid.select("src", "dst").mapInArrow(run, "part long, name string, kinds array<string>").collect():  # a row a file
        for kind in r.kinds:
            store.move(f"{r.name}{kind}", f"{root}/part-{r.part:05d}{kind}")
        paths.append(f"{uri}/part-{r.part:05d}")
    return sorted(paths)


def write_hilbert(e: DataFrame, uri: str, parts: int) -> list[str]:
    """Edges in up to ``parts`` files of two levels that follow one another along the curve; a block that reaches over a file's
    end has a record in each. A task holds a batch of edges at a time."""

    def write(batches: Iterator[pa.RecordBatch], streams: dict) -> int:
        block, count, total = None, 0, 0
        head = lambda b, n: streams["-upper"].write(np.array([*b, n], "<u4").tobytes())
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in range(2))
            if not len(x):
                continue
            streams["-lower"].write((x & 0xFFFF | (y & 0xFFFF) << 16).astype("<u4").tobytes())
            total += len(x)
            first = np.flatnonzero(np.append(True, ((x[1:] ^ x[:-1]) | (y[1:] ^ y[:-1])) >> 16 != 0))
            for k, n in zip(first.tolist(), np.diff(np.append(first, len(x))).tolist(), strict=True):
                now = int(x[k]) >> 16, int(y[k]) >> 16
                if now == block:
                    count += n
                    continue
                if block is not None:
                    head(block, count)
                block, count = now, n
        if block is not None:
            head(block, count)
        return total

    return _written(_along_curve(e, parts, 48), uri, write, ("-upper", "-lower"))


def write_split_parts(e: DataFrame, uri: str, part: Column, tasks: int) -> dict[int, str]:
    """Node and edge files for each value of ``part`` (an expression over ``src`` and ``dst``): each part's own degrees beside its
    targets, sorted by source. Returns the parts' prefixes, as the readers take them; parts without edges have none. A part is
    sorted by many tasks, ``tasks`` at least, and its stretches are then copied together; a task holds a batch of edges."""

    def write(streams: dict, rows: list[np.ndarray], state: list) -> None:
        src, dst = rows
        first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        heads = np.stack([src[first], np.diff(np.append(first, len(src)))], 1)
        if state[2] == heads[0, 0]:
            heads[0, 1] += state[3]
        else:
            heads = np.concatenate([[state[2:4]], heads])
        state[2:4] = heads[-1].tolist()  # the vertex whose edges may go on, and how many it has so far
        streams["-nodes"].write(_ids(heads[:-1].ravel()).tobytes())
        streams["-edges"].write(_ids(dst).tobytes())

    placed = e.select(part.cast("long").alias("part"), "src", "dst")
    found = _segments(_ranged(placed, tasks, "part", "src", "dst"), uri, ("-nodes", "-edges"), write)
    _, root = fs.FileSystem.from_uri(uri)
    files = {}
    for p, own in found.items():
        files[f"{root}/part-{p}-edges"] = [[f"{r.name}-edges", 0] for r in own]
        files[f"{root}/part-{p}-nodes"] = _node_pieces(own)
    _joined(e.sparkSession, uri, files)
    return {p: f"{uri}/part-{p}" for p in found}


def _node_pieces(own: list) -> list:
    """A part's node file from those of its stretches, whose last vertex is left out: it may go on in the next one."""
    pieces, vertex, n = [], None, 0
    for r in own:
        if vertex is not None and vertex != r.first:
            pieces.append([vertex, n])
            n = 0
        pieces.append([f"{r.name}-nodes", n if r.first != r.last else 0])
        vertex, n = r.last, r.n + (n if r.first == r.last else 0)
    return [*pieces, [vertex, n]]


LEVELS = {"-high32": "<u4", "-next16": "<u2", "-next08": "u1", "-last08": "u1"}
PAGES = "-pages"


def encode_prefixes(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct cells in the order of the curve as four nested levels of their bits (see ``hilbert.PREFIXES``). Each record of
    the first three is a value and how many records of the next level it has; a full count of 256 cells is written 0."""
    groups = {}
    for (name, (low, bits)), level in zip(hilbert.PREFIXES.items(), LEVELS, strict=True):
        groups[level] = (x >> low & (1 << bits) - 1) << bits | (y >> low & (1 << bits) - 1)
    out, fresh, inner = {}, np.zeros(len(x), bool), np.arange(len(x))
    fresh[:1] = True
    opens = []
    for level in list(LEVELS)[:3]:
        values = groups[level]
        fresh = fresh | np.append(fresh[:1], values[1:] != values[:-1])[: len(x)]
        opens.append(np.flatnonzero(fresh))
    out["-last08"] = groups["-last08"].astype("u1")
    below = inner
    for level, starts in zip(list(LEVELS)[2::-1], opens[::-1], strict=True):
        counts = np.diff(np.append(np.searchsorted(below, starts), len(below)))
        most = 1 << 8 * np.dtype(LEVELS[level]).itemsize
        if len(counts) and int(counts.max()) > most:
            raise ValueError("cells repeat: the prefix encoding keeps each once")
        out[level] = np.stack([groups[level][starts], counts % most], 1).astype(LEVELS[level]).ravel()
        below = starts
    return out


def decode_prefixes(levels: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cells of :func:`encode_prefixes`, in order."""
    values: dict[str, np.ndarray] = {}
    for level in list(LEVELS)[:3]:
        pairs = levels[level].reshape(-1, 2).astype(np.int64)
        counts = np.where(pairs[:, 1] == 0, 1 << 8 * np.dtype(LEVELS[level]).itemsize, pairs[:, 1])
        values[level] = pairs[:, 0]
        values = {k: np.repeat(v, counts) for k, v in values.items()}
    values["-last08"] = levels["-last08"].astype(np.int64)
    if len({len(v) for v in values.values()}) > 1:
        raise ValueError(f"levels do not fit: {({k: len(v) for k, v in values.items()})}")
    x = y = np.zeros(len(values["-last08"]), np.int64)
    for level, (low, bits) in zip(LEVELS, hilbert.PREFIXES.values(), strict=True):
        x, y = x | values[level] >> bits << low, y | (values[level] & (1 << bits) - 1) << low
    return x, y


def _open_end(x: np.ndarray, y: np.ndarray) -> int:
    """Where the last block of 2^8 by 2^8 cells begins, which may go on."""
    same = ((x ^ x[-1]) | (y ^ y[-1])) >> 8 != 0
    return int(np.flatnonzero(same)[-1]) + 1 if same.any() else 0


def write_prefixes(e: DataFrame, uri: str, parts: int) -> list[str]:
    """Distinct edges in up to ``parts`` files of four levels, along the curve; a task holds some blocks of 2^16 cells at a time."""

    def write(batches: Iterator[pa.RecordBatch], streams: dict) -> int:
        top, total, held = np.empty((0, 2), "<u4"), 0, []
        page = np.zeros(3, "<i8")  # the one that is being written, and its records so far

        def close() -> None:
            streams["-high32"].write(top.tobytes())
            page[2] += len(top)
            if page[:2].any() or streams[PAGES].tell():
                streams[PAGES].write(page.tobytes())

        def add(cells: np.ndarray) -> None:
            nonlocal top
            coded = encode_prefixes(*cells)
            own = coded.pop("-high32").reshape(-1, 2)
            if len(top) and len(own) and top[0, 0] == own[0, 0]:
                own[0, 1] += top[0, 1]
            else:
                own = np.concatenate([top, own])
            streams["-high32"].write(own[:-1].tobytes())  # the last one may go on
            page[2] += len(own) - 1
            top = own[-1:]
            for level, data in coded.items():
                streams[level].write(data.tobytes())

        def add_pages(cells: np.ndarray) -> None:
            nonlocal top
            pages = cells >> 32
            for own in np.split(np.arange(cells.shape[1]), np.flatnonzero((pages[:, 1:] != pages[:, :-1]).any(axis=0)) + 1):
                now = pages[:, own[0]]
                if (page[:2] != now).any():
                    if page[2] or len(top):
                        if not page[:2].any():  # the first page has a record only where others follow
                            streams[PAGES].write(np.array([0, 0, page[2] + len(top)], "<i8").tobytes())
                            streams["-high32"].write(top.tobytes())
                        else:
                            close()
                    page[:], top = [*now, 0], top[:0]
                add(cells[:, own])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(2)]))
            total += len(batch)
            if sum(h.shape[1] for h in held) >= CHUNK:
                cells = np.concatenate(held, axis=1)
                end = _open_end(*cells)
                if end:
                    add_pages(cells[:, :end])
                held = [cells[:, end:]]
        if total:
            add_pages(np.concatenate(held, axis=1))
            close()
        return total

    return _written(_along_curve(e.select("src", "dst").distinct(), parts, 63), uri, write, (*LEVELS, PAGES))


class _Pages:
    """What lies beyond 32 bits of the first level's records, once for each."""

    def __init__(self, path: str):
        self.stream, self.page, self.left = _open(path + PAGES), None, 0

    def take(self, n: int) -> list[np.ndarray]:
        found = []
        while n:
            while not self.left:
                data = self.stream.read(24)
                if not data:
                    raise ValueError(f"levels do not fit: {n} records too many")
                *self.page, self.left = np.frombuffer(data, "<i8").tolist()
            used = min(n, self.left)
            found.append(np.repeat(np.array(self.page, np.int64)[:, None], used, axis=1))
            n, self.left = n - used, self.left - used
        return [*np.concatenate(found, axis=1)]

    def close(self) -> None:
        if self.left or self.stream.read(1):
            raise ValueError("levels do not fit: records too few")
        self.stream.close()


class _Runs:
    """A level's values, each once for every record of the next level, with those of the levels above; read in stretches."""

    def __init__(self, path: str, level: str, above: _Runs | _Pages | None = None):
        self.stream, self.type, self.above = _open(path + level), np.dtype(LEVELS[level]), above
        self.rows, self.left = [np.empty(0, np.int64)], np.empty(0, np.int64)

    def _more(self) -> bool:
        data = self.stream.read(2 * self.type.itemsize * (CHUNK >> 6))
        if data:
            pairs = np.frombuffer(data, self.type).reshape(-1, 2).astype(np.int64)
            self.left = np.where(pairs[:, 1] == 0, 1 << 8 * self.type.itemsize, pairs[:, 1])
            self.rows = [pairs[:, 0], *(self.above.take(len(pairs)) if self.above else ())]
        return bool(data)

    def take(self, n: int) -> list[np.ndarray]:
        found = []
        while n:
            if not len(self.left) and not self._more():
                raise ValueError(f"levels do not fit: {n} records too many")
            ends = np.minimum(np.cumsum(self.left), n)
            used = np.diff(ends, prepend=0)
            found.append([np.repeat(r, used) for r in self.rows])
            n -= int(ends[-1])
            self.left = self.left - used
            self.rows = [r[self.left > 0] for r in self.rows]
            self.left = self.left[self.left > 0]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def close(self) -> None:
        if len(self.left) or self.stream.read(1):
            raise ValueError("levels do not fit: records too few")
        self.stream.close()
        if self.above:
            self.above.close()


def read_prefixes(path: str) -> Iterator[pa.RecordBatch]:
    """The cells of :func:`write_prefixes`, some at a time of all levels."""
    *upper, lowest = LEVELS
    store, name = fs.FileSystem.from_uri(path + PAGES)
    runs = paged = _Pages(path) if store.get_file_info(name).type == fs.FileType.File else None
    for level in upper:
        runs = _Runs(path, level, runs)
    with _open(path + lowest) as stream:
        while data := stream.read(CHUNK):
            last = np.frombuffer(data, LEVELS[lowest]).astype(np.int64)
            x = y = np.zeros(len(last), np.int64)
            groups = runs.take(len(last))
            if paged:
                x, y = groups[-2] << 32, groups[-1] << 32
            for values, (low, bits) in zip([last, *groups[:3]], list(hilbert.PREFIXES.values())[::-1], strict=True):
                x, y = x | values >> bits << low, y | (values & (1 << bits) - 1) << low
            yield pa.record_batch([pa.array(x), pa.array(y)], names=["src", "dst"])
    runs.close()


def prefix_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``level, records`` of files of four levels: how many records each level has, over all of them, by the files' sizes."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for path in f["path"]:
                for k, (level, kind) in enumerate(LEVELS.items()):
                    store, name = fs.FileSystem.from_uri(path + level)
                    size = store.get_file_info(name).size
                    yield pd.DataFrame({"level": [level[1:]], "records": [size // np.dtype(kind).itemsize // (2 if k < 3 else 1)]})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))
    return files.mapInPandas(run, "level string, records long").groupBy("level").agg(F.sum("records").alias("records"))
