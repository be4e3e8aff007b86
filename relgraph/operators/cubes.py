"""Triangles, cliques and paths of two edges by blocks of a graph that lies in files.

Edges are packed, dealt to blocks by ranges of their source and written once, sorted, as Parquet in the folder that all executors
share. A task holds one block, all edges of its sources, and reads those blocks through that the targets of its own edges
lead to, some lists at a time. So nothing but the packed edges is shuffled and written, once, however many blocks there are; what
is read grows with their number. A block has about ``CELL_EDGES`` edges, and those of a source are never parted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hold, shared_dir

#: Edges that a block has on average, and the fewest for which a graph is cut into more blocks than that asks for.
CELL_EDGES, LEAST_EDGES = 1 << 23, 1 << 16
#: Edges packed at a time, and candidates looked at at a time.
PACK, CHUNK = 1 << 20, 1 << 21
#: Values in a list that leaves in one row.
MAX_LIST = 1 << 20
#: log2 of the values whose bits stay together, and the words they take.
SHIFT, WORDS = 9, 8
PACKED = "wide boolean, keys binary, counts binary, vals binary"


def _heads(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    fresh = key[1:] != key[:-1]
    for other in more:
        fresh |= other[1:] != other[:-1]
    return np.flatnonzero(np.append(True, fresh)[: len(key)])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[k]`` to ``starts[k] + sizes[k]`` of all k, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct edges in order."""
    if not len(key):
        return key, value
    low, least, span = int(key.min()), int(value.min()), int(value.max()) - int(value.min()) + 1
    if (int(key.max()) - low + 1) * span < 1 << 63:  # as one number
        code = (key - low) * span + (value - least)
        code.sort()
        code = code[_heads(code)]
        return code // span + low, code % span + least
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = _heads(key, value)
    return key[first], value[first]


def _pack(key: np.ndarray, value: np.ndarray) -> list:
    """Sorted edges as the columns of ``PACKED``."""
    first = _heads(key)
    wide = bool(min(key.min(), value.min()) < -(1 << 31) or max(key.max(), value.max()) >= 1 << 31)
    kind = "<i8" if wide else "<i4"
    return [wide, key[first].astype(kind).tobytes(), np.diff(np.append(first, len(key))).astype("<i4").tobytes(), value.astype(kind).tobytes()]


def _lists(wide: bool, keys: bytes, counts: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = "<i8" if wide else "<i4"
    return np.frombuffer(keys, kind).astype(np.int64), np.frombuffer(counts, "<i4").astype(np.int64), np.frombuffer(vals, kind)


def _batch(schema: str, rows: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


@dataclass
class Layout:
    """A graph's blocks in files: where each block's sources begin, its files, and for each the least and greatest source and value."""

    bounds: np.ndarray
    files: list[list[str]]
    ends: np.ndarray

    def _read(self, block: int, columns: list[str]) -> Iterator[Iterator[tuple]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for path in self.files[block]:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(batch_size=1, columns=columns):
                    yield zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    def lists(self, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A block's sources, how many values each has, and the values, some whole lists at a time."""
        for batch in self._read(block, ["wide", "keys", "counts", "vals"]):
            yield from (_lists(*row) for row in batch)

    def edges(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        own = [(np.repeat(k, n), v) for k, n, v in self.lists(block)]
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*own, strict=True) if own else ((), ())))

    def degrees(self, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A block's sources and how many values each has."""
        for batch in self._read(block, ["keys", "counts", "wide"]):
            for keys, counts, wide in batch:
                yield _lists(wide, keys, counts, b"")[:2]

    def with_sources(self, ids: np.ndarray) -> list[int]:
        """The blocks that may have sorted ``ids`` as sources."""
        return [k for k, (low, high, _, _) in enumerate(self.ends) if self.files[k] and np.searchsorted(ids, low) < np.searchsorted(ids, high, "right")]

    def with_values(self, low: int, high: int) -> list[int]:
        """The blocks that may have values from ``low`` to ``high``."""
        return [k for k, (_, _, a, b) in enumerate(self.ends) if self.files[k] and a <= high and low <= b]


def laid_out(rows: DataFrame, *ways: str) -> list[Layout]:
    """``rows`` (``key, value``; duplicates count once, nulls go) in blocks, once for each of ``ways``: ``out`` by key, ``in`` by value,
    whose lists are of keys, or ``both``, each edge in both directions."""
    mark = max(1, PACK >> 8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = f"n long, keys_at array<long>, values_at array<long>, {PACKED}"
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            key, value = _sorted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return _batch(schema, [[len(key), key[::mark], value[::mark], *_pack(key, value)]])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in range(2)))
            n += len(batch)
            if n >= PACK:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    pairs = rows.select(F.col("key").cast("long").alias("key"), F.col("value").cast("long").alias("value")).filter("key is not null and value is not null")
    packs = hold(pairs.mapInArrow(pack, f"n long, keys_at array<long>, values_at array<long>, {PACKED}"))
    edges = packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = [_laid_out(packs, way, edges) for way in ways]
    packs.unpersist()
    return found


def _laid_out(packs: DataFrame, way: str, edges: int) -> Layout:
    from pyarrow import fs

    spark = packs.sparkSession
    edges = 2 * edges if way == "both" else edges
    number = max(1, ceil(edges / CELL_EDGES), min(2 * spark.sparkContext.defaultParallelism, edges // LEAST_EDGES))
    marks = {"out": F.col("keys_at"), "in": F.col("values_at"), "both": F.concat("keys_at", "values_at")}[way]
    cuts = packs.select(F.explode(marks).alias("m")).agg(F.percentile_approx("m", [k / number for k in range(1, number)], 100 * number)).first()[0] if number > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))
    blocks = len(bounds) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                keys, counts, value = _lists(*row)
                key, value = np.repeat(keys, counts), value.astype(np.int64)
                for k, v in [(key, value)] * (way != "in") + [_sorted(value, key)] * (way != "out"):
                    at = np.searchsorted(bounds, k, "right")
                    for low, high in zip(first := _heads(at), np.append(first[1:], len(at)), strict=True):
                        yield _batch(f"block int, {PACKED}", [[int(at[low]), *_pack(k[low:high], v[low:high])]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                held.setdefault(block, []).append(row)
        while held:
            block = next(iter(held))
            own = [_lists(*row) for row in held.pop(block)]
            key, value = _sorted(np.concatenate([np.repeat(k, n) for k, n, _ in own]), np.concatenate([v for _, _, v in own]).astype(np.int64))
            del own
            first = np.append(_heads(key), len(key))
            at = 0
            while at < len(first) - 1:  # whole lists
                to = max(int(np.searchsorted(first, first[at] + PACK, "right")) - 1, at + 1)
                k, v = key[first[at] : first[to]], value[first[at] : first[to]]
                yield _batch(f"block int, low long, high long, least long, most long, {PACKED}", [[block, int(k[0]), int(k[-1]), int(v.min()), int(v.max()), *_pack(k, v)]])
                at = to

    dealt = packs.select("wide", "keys", "counts", "vals").mapInArrow(deal, f"block int, {PACKED}").repartitionById(blocks, "block")
    to = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, f"block int, low long, high long, least long, most long, {PACKED}").write.partitionBy("block").parquet(to)
    files: list[list[str]] = [[] for _ in range(blocks)]
    ends = np.zeros((blocks, 4), np.int64)
    if edges:
        store, root = fs.FileSystem.from_uri(to)
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.path.endswith(".parquet"):
                files[int(info.path.split("/block=")[1].split("/")[0])].append(f"{to}/{info.path.split(root + '/', 1)[1]}")
        for r in spark.read.parquet(to).groupBy("block").agg(F.min("low"), F.max("high"), F.min("least"), F.max("most")).collect():  # a row a block
            ends[r[0]] = r[1:]
    return Layout(bounds, files, ends)


def _in_blocks(spark: SparkSession, layout: Layout, each, schema: str) -> DataFrame:
    """``each`` (a block's number to record batches) over all blocks, a task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                if layout.files[block]:
                    yield from each(block)

    return spark.range(0, len(layout.files), 1, len(layout.files)).mapInArrow(run, schema)


def oriented_by_degree(rows: DataFrame) -> DataFrame:
    """``key, value`` of edges without their direction, from lower to higher degree, of equal degrees from the smaller to the larger id
    (see ``prep.orient_by_degree``): a block's sources have all their edges, and the degrees of the other ends are read along."""
    (layout,) = laid_out(rows.filter("key <> value"), "both")

    def each(block: int) -> Iterator[pa.RecordBatch]:
        key, value = layout.edges(block)
        n = np.diff(np.append(_heads(key), len(key)))
        ids, own = np.unique(value, return_inverse=True)
        found = np.zeros(len(ids), np.int64)
        for other in layout.with_sources(ids):
            for keys, counts in layout.degrees(other):
                at, there = _places(ids, keys)
                found[at[there]] = counts[there]
        low, high = np.repeat(n, n), found[own]
        keep = (low < high) | ((low == high) & (key < value))
        key, value = key[keep], value[keep]
        for at in range(0, len(key), PACK):
            yield pa.record_batch([pa.array(x[at : at + PACK]) for x in (key, value)], names=["key", "value"])

    return _in_blocks(rows.sparkSession, layout, each, "key long, value long")


class _Table:
    """Where ids stand in a sorted table of them; -1 where they don't."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.low = ids, int(ids[0])
        self.at = None
        if int(ids[-1]) - self.low < max(1 << 26, 8 * len(ids)):
            self.at = np.full(int(ids[-1]) - self.low + 2, -1, np.int32)  # what lies outside finds the last entry
            self.at[ids - self.low] = np.arange(len(ids), dtype=np.int32)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        if self.at is not None:
            last = len(self.at) - 1
            own = values - self.low if values.dtype == np.int64 or self.low == 0 else values.astype(np.int64) - self.low
            return self.at[np.where((own >= 0) & (own < last), own, last)]
        at = np.minimum(np.searchsorted(self.ids, values), len(self.ids) - 1)
        return np.where(self.ids[at] == values, at, -1)


def _places(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values stand in a sorted table, and whether they do."""
    at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
    return at, table[at] == values if len(table) else np.zeros(len(values), bool)


def _as_words(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted edges as words of 64 bits: key, the word's number, its bits."""
    first = _heads(key, word := value >> 6)
    bit = np.left_shift(np.uint64(1), (value & 63).astype(np.uint64))
    return key[first], word[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit


def _met(layout: Layout, block: int, bits: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """The triangles of a block's sources, some at a time: a, b and c, by b, a and c; with ``bits`` c's word and the bits in place of c."""
    a, b = layout.edges(block)
    ua, ia = np.unique(a, return_inverse=True)
    # pairs of a and c as one number each, sorted as edges are
    c, cw = (b, None) if not bits else (None, None)
    ic = ia
    if bits:
        ic, c, cw = _as_words(ia, b)
    least, span = int(c.min()), int(c.max()) - int(c.min()) + 1
    ranks = None if len(ua) * span < 1 << 62 else np.unique(c)
    pairs = ic * span + (c - least) if ranks is None else ic * len(ranks) + np.searchsorted(ranks, c)
    size = 1 << min(max(8 * len(pairs), 2).bit_length(), 27)
    seen = np.zeros(size, bool)
    place = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)
    seen[place(pairs)] = True
    order = np.argsort(b, kind="stable")
    ub, starts, numbers = np.unique(b[order], return_index=True, return_counts=True)
    by_b = ia[order].astype(np.int32)
    del a, b, ia, ic, order
    for other in layout.with_sources(ub):
        for keys, counts, vals in layout.lists(other):
            own, there = _places(ub, keys)
            if not there.any():
                continue
            word = None
            at = np.flatnonzero(there)
            values = vals[_spans((np.cumsum(counts) - counts)[at], counts[at])].astype(np.int64)
            key, n, own = keys[at], counts[at], own[at]
            if bits:
                owner, values, word = _as_words(np.repeat(np.arange(len(at)), n), values)
                n = np.bincount(owner, minlength=len(at))
            if ranks is None:  # values that no pair has go
                code, fits = values - least, (values >= least) & (values < least + span)
            else:
                code, fits = _places(ranks, values)
            if not fits.all():
                n = np.bincount(np.repeat(np.arange(len(at)), n)[fits], minlength=len(at))
                code, values, word = code[fits], values[fits], word[fits] if bits else None
            first, each = np.cumsum(n) - n, span if ranks is None else len(ranks)
            # a pair (a, b) meets b's values
            who = np.repeat(np.arange(len(at)), numbers[own])
            source = by_b[_spans(starts[own], numbers[own])]
            sizes = n[who]
            ends = np.cumsum(sizes)
            at_pair = 0
            while at_pair < len(source):
                done = int(ends[at_pair - 1]) if at_pair else 0
                to = max(int(np.searchsorted(ends, done + CHUNK, "right")), at_pair + 1)
                alone = to == at_pair + 1
                for low in range(0, int(sizes[at_pair]) if alone else 1, CHUNK):  # a hub's list in stretches
                    left = np.minimum(sizes[at_pair:to] - low, CHUNK) if alone else sizes[at_pair:to]
                    pair = np.repeat(np.arange(at_pair, to), left)
                    entry = _spans(first[who[at_pair:to]] + low, left)
                    want = source[pair].astype(np.int64) * each + code[entry]
                    some = np.flatnonzero(seen[place(want)])
                    hit, found = _places(pairs, want[some])
                    some, hit = some[found], hit[found]
                    both = None
                    if bits:
                        both = cw[hit] & word[entry[some]]
                        some, both = some[both != 0], both[both != 0]
                    if len(some):
                        yield (ua[source[pair[some]]], key[who[pair[some]]], values[entry[some]], *((both,) if bits else ()))
                at_pair = to


def _whole(found: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What is found, with no pair parted unless it has more than ``most`` values: the last pair waits for what follows."""
    held = None
    for now in found:
        now = tuple(np.concatenate(x) for x in zip(held, now, strict=True)) if held else now
        last = int(_heads(now[0], now[1])[-1])
        last = len(now[0]) if len(now[0]) - last > most else last
        held = tuple(x[last:] for x in now) if last < len(now[0]) else None
        if last:
            yield tuple(x[:last] for x in now)
    if held:
        yield held


def _over(rows: DataFrame, bits: bool, each, schema: str) -> DataFrame:
    (layout,) = laid_out(rows, "out")
    return _in_blocks(rows.sparkSession, layout, lambda block: each(_met(layout, block, bits)), schema)


def triangle_lists(rows: DataFrame) -> DataFrame:
    """``a, b, c``: pairs with the sorted list of third vertices, a pair in one row unless it has more than ``MAX_LIST``."""

    def each(found):
        for a, b, c in _whole(found, MAX_LIST):
            first = _heads(a, b)
            yield pa.record_batch([pa.array(a[first]), pa.array(b[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(c)).astype(np.int32)), pa.array(c))], names=["a", "b", "c"])

    return _over(rows, False, each, "a long, b long, c array<long>")


def triangle_rows(rows: DataFrame) -> DataFrame:
    """``a, b, c``, a row a triangle."""

    def each(found):
        for own in found:
            yield pa.record_batch([pa.array(x) for x in own], names=["a", "b", "c"])

    return _over(rows, False, each, "a long, b long, c long")


def triangle_sums(rows: DataFrame) -> DataFrame:
    """``a, b, n_c, sum_c``: how many triangles a pair has and the sum of their c, a row a pair that has any."""

    def each(found):
        held = np.empty((4, 0), np.int64)  # the last pair's sums wait for what follows
        for a, b, c in found:
            first = _heads(a, b)
            own = np.stack([a[first], b[first], np.diff(np.append(first, len(c))), np.add.reduceat(c, first)])
            if held.shape[1] and (held[:2, 0] == own[:2, 0]).all():
                own[2:, 0] += held[2:, 0]
            elif held.shape[1]:
                own = np.concatenate([held, own], axis=1)
            held = own[:, -1:]
            yield pa.record_batch([pa.array(x) for x in own[:, :-1]], names=["a", "b", "n_c", "sum_c"])
        yield pa.record_batch([pa.array(x) for x in held], names=["a", "b", "n_c", "sum_c"])

    return _over(rows, False, each, "a long, b long, n_c long, sum_c long")


def triangle_bits(rows: DataFrame, edges: int | None = None) -> DataFrame:
    """``a, b, block, w0 ... w7``: pairs with the bits of third vertices. A pair's block may have several rows, of different bits.
    The number of ``edges`` may be given and is not needed."""

    def each(found):
        for a, b, word, bits in found:
            first, words = _in_words(a, b, word, bits)
            yield pa.record_batch([pa.array(x) for x in (a[first], b[first], word[first] >> SHIFT - 6, *words.T.view(np.int64))], names=["a", "b", "block", *(f"w{i}" for i in range(WORDS))])

    return _over(rows, True, each, f"a long, b long, block long, {', '.join(f'w{i} long' for i in range(WORDS))}")


def _in_words(a: np.ndarray, b: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair's blocks begin, and the eight words of each."""
    first = _heads(a, b, word >> SHIFT - 6)
    words = np.zeros((len(first), WORDS), np.uint64)
    words[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a)))), word & WORDS - 1] = bits
    return first, words


def triangle_number(rows: DataFrame, bits: bool = False, out: str = "triangles") -> DataFrame:
    """The number of triangles, of which no row is made."""

    def each(found):
        n = sum(int(np.bitwise_count(f[3]).sum()) if bits else len(f[0]) for f in found)
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return _over(rows, bits, each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(out))


# --- paths of two edges ------------------------------------------------------------------------------------------------


def _paths(a: np.ndarray, b: np.ndarray, by_end: Layout, within: range | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ends a and d of paths over edges (a, b) and the (b, d) of ``by_end``, whose lists are those of d, and how many paths they
    have: a d's together, some at a time. ``within``: only d's below the a, as far as the blocks of that range."""
    if not len(a):
        return
    ua, ia = np.unique(a, return_inverse=True)
    order = np.argsort(b, kind="stable")
    ub, starts, numbers = np.unique(b[order], return_index=True, return_counts=True)
    by_b = ia[order].astype(np.int32)
    del a, b, ia, order
    table = _Table(ub)
    for other in by_end.with_values(int(ub[0]), int(ub[-1])):
        if within is not None and other not in within:
            continue
        for keys, counts, vals in by_end.lists(other):
            at = table(vals)
            entry = np.flatnonzero(at >= 0)
            at = at[entry]
            who = np.repeat(np.arange(len(keys)), counts)[entry]
            sizes = numbers[at]
            ends = np.cumsum(sizes)
            bounds = np.append(_heads(who), len(who))
            k = 0
            while k < len(bounds) - 1:
                done = int(ends[bounds[k] - 1]) if bounds[k] else 0
                to = max(int(np.searchsorted(ends[bounds[1:] - 1], done + CHUNK, "right")), k + 1)
                low, high = int(bounds[k]), int(bounds[to])
                code = by_b[_spans(starts[at[low:high]], sizes[low:high])] + np.repeat(who[low:high] * len(ua), sizes[low:high])
                code.sort()
                first = _heads(code)
                d, x = keys[code[first] // len(ua)], ua[code[first] % len(ua)]
                keep = d < x if within is not None else d != x
                yield x[keep], d[keep], np.diff(np.append(first, len(code)))[keep]
                k = to


def _over_paths(rows: DataFrame, each, schema: str) -> DataFrame:
    starts, by_end = laid_out(rows, "out", "in")
    return _in_blocks(rows.sparkSession, starts, lambda block: each(_paths(*starts.edges(block), by_end)), schema)


def path_counts(rows: DataFrame) -> DataFrame:
    """``a, d, paths``: how many paths of two edges lead from a to another d."""

    def each(found):
        for own in found:
            yield pa.record_batch([pa.array(x) for x in own], names=["a", "d", "paths"])

    return _over_paths(rows, each, "a long, d long, paths long")


def _pairs_of(found: Iterator[tuple[np.ndarray, ...]], times: int) -> Iterator[pa.RecordBatch]:
    yield pa.record_batch([pa.array([times * sum(int((n * (n - 1)).sum()) for _, _, n in found)], pa.int64())], names=["n"])


def path_pairs(rows: DataFrame, out: str) -> DataFrame:
    """The ordered pairs of different paths of two edges between the same two vertices, none of them made a row."""
    return _over_paths(rows, lambda found: _pairs_of(found, 1), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(out))


def path_pairs_both_ways(rows: DataFrame, out: str) -> DataFrame:
    """:func:`path_pairs` of edges that lead both ways, each given once or twice. A cycle of four edges has eight of them and is found
    once, from its largest vertex: the paths from there over smaller ones to a smaller one."""
    (layout,) = laid_out(rows.filter("key <> value"), "both")

    def each(block: int) -> Iterator[pa.RecordBatch]:
        a, b = layout.edges(block)
        down = b < a
        return _pairs_of(_paths(a[down], b[down], layout, range(block + 1)), 4)

    return _in_blocks(rows.sparkSession, layout, each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(out))


# --- cliques from the triangles of a vertex ----------------------------------------------------------------------------


def _grown(key: np.ndarray, block: np.ndarray, words: np.ndarray, last: np.ndarray, members: np.ndarray, index: tuple, left: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Cliques of ``left`` members more, but for their last: the members, and the blocks and words of the last ones. Prefixes: ``key``
    (sorted, entries of one prefix together), ``block`` and ``words``, the vertices that all ``members`` allow; ``last`` is an
    entry's first vertex's number, under which ``index`` has its triangles."""
    numbers, vertices, heads, sizes, index_block, index_words = index
    if left == 1:
        yield members[key], numbers[block], words
        return
    blocks = len(numbers)
    own = key * blocks + block
    for low in range(0, len(key), 1 << 12):
        entry, bit = np.nonzero(np.unpackbits(words[low : low + (1 << 12)].view(np.uint8), axis=1, bitorder="little"))
        entry += low
        row, there = _places(vertices, last[entry] * blocks * (1 << SHIFT) + block[entry] * (1 << SHIFT) + bit)
        entry, bit, row = entry[there], bit[there], row[there]
        n = sizes[row]
        new = np.repeat(np.arange(len(row)), n)
        at = _spans(heads[row], n)
        place, found = _places(own, key[entry[new]] * blocks + index_block[at])
        both = words[place] & index_words[at]
        keep = found & both.any(axis=1)
        grown = np.concatenate([members[key[entry]], (numbers[block[entry]] * (1 << SHIFT) + bit)[:, None]], axis=1)
        yield from _grown(new[keep], index_block[at[keep]], both[keep], last[entry[new[keep]]], grown, index, left - 1)


def _cliques_of(a: np.ndarray, b: np.ndarray, block: np.ndarray, words: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Cliques of k vertices whose first is among ``a``, from all triangles of these: see :func:`_grown`."""
    ub, dense = np.unique(block, return_inverse=True)
    at, there = _places(ub, b >> SHIFT)
    _, ia = np.unique(a, return_inverse=True)
    first = _heads(a, b)
    pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
    # a's triangles by the pair's second vertex, as one number; vertices that are nobody's third can't be reached
    number = (ia * len(ub) + at) * (1 << SHIFT) + (b & (1 << SHIFT) - 1)
    reach = there[first]
    vertices, heads, sizes = number[first][reach], first[reach], np.diff(np.append(first, len(a)))[reach]
    return _grown(pair, dense, words, ia, np.stack([a[first], b[first]], 1), (ub, vertices, heads, sizes, dense, words), k - 2)


def _clique_rows(rows: DataFrame, k: int, each, schema: str) -> DataFrame:
    """``each`` over the cliques of k vertices, k at least 4: a block's triangles, as words of bits, are sorted by their first vertex
    where they are, and a task holds those of some vertices at a time."""

    def words(found):
        for own in found:
            yield pa.record_batch([pa.array(x) for x in (*own[:3], own[3].view(np.int64))], names=["a", "b", "word", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def cliques(own: np.ndarray):
            a, b, word, bits = (np.ascontiguousarray(x) for x in own)
            first, whole = _in_words(a, b, word, bits.view(np.uint64))
            return each(_cliques_of(a[first], b[first], word[first] >> SHIFT - 6, whole, k))

        for batch in batches:
            if not len(batch):
                continue
            held.append(np.stack([batch.column(c).to_numpy() for c in range(4)]))
            n += len(batch)
            if n < 1 << 15:
                continue
            own = np.concatenate(held, axis=1)
            end = int(np.searchsorted(own[0], own[0, -1]))  # the last vertex's may go on
            if end:
                yield from cliques(own[:, :end])
            held, n = [own[:, end:]], 0
        if held:
            yield from cliques(np.concatenate(held, axis=1))

    found = _over(rows, True, words, "a long, b long, word long, bits long")
    return found.sortWithinPartitions("a", "b", "word").mapInArrow(run, schema)


def clique_number(rows: DataFrame, k: int, out: str) -> DataFrame:
    """The number of cliques of k vertices, k at least 4, over edges whose directions have no cycle."""

    def each(found):
        yield pa.record_batch([pa.array([sum(int(np.bitwise_count(words).sum()) for _, _, words in found)], pa.int64())], names=["n"])

    return _clique_rows(rows, k, each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(out))


def clique_bits(rows: DataFrame, names: list[str]) -> DataFrame:
    """Cliques: ``names`` (at least three) and ``block, w0 ... w7``, the bits of one vertex more."""
    columns = [*names, "block", *(f"w{i}" for i in range(WORDS))]

    def each(found):
        for members, block, words in found:
            if len(block):
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in (*members.T, block, *words.T.view(np.int64))], names=columns)

    return _clique_rows(rows, len(names) + 1, each, ", ".join(f"{c} long" for c in columns))
