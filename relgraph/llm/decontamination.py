"""Benchmark decontamination by CGK embeddings and bit sampling.

A document is contaminated by an item of n words if one of its windows of n words (a shorter text's only window, filled up
with words unlike any other) is within ``floor(max_edit * n)`` word edits of the item. The search:

1. The q-gram lemma names, without loss, the places worth a look: a window within k edits shares at least
   ``n - q + 1 - k q`` of its q-grams with the item (q is 3 where that leaves one, else 2 or 1).
2. Each item-sized window there is embedded by CGK random walks, which map edit distance to Hamming distance: at step j the
   walk emits the current word and advances if a random bit of (j, word) says so.
3. Bit sampling: ``SAMPLES`` positions of a walk's output make a key; a window is a candidate of every item of its size with
   an equal key in one of the tables, ``KEYS`` for each of as many walks as the target recall needs at its size.
4. Candidates are verified by the exact edit distance.

Items are broadcast in blocks of at most ``BLOCK_WORDS`` words, each block a pass over the documents, so what is broadcast
is bounded whatever the benchmark's size; documents are never shuffled.

Defined results: null or empty texts and items match nothing; repeated documents are reported each; items with one id are
told apart only by it; an empty table on either side gives an empty result; other columns are ignored. Whole texts are
searched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import document_key, read
from .words import U, fold, mix, slices, split_words

MAX_EDIT = 0.2
RECALL = 0.999
#: Positions in a key, and keys of a walk.
SAMPLES, KEYS = 3, 20
#: How often one walk's keys find a window at the largest distance allowed, by its words (250 windows with substitutions,
#: insertions and deletions, 48 walks; see the tests). Walks are independent of each other, the keys of one are not.
FOUND = ((60, 0.88), (120, 0.85), (240, 0.80), (480, 0.76))
#: Walks beyond those the target recall needs at these rates, as windows differ in how easily they are found.
SPARE = 2
BLOCK_WORDS = 200_000
STRETCH = 3


def found_rate(n: int) -> float:
    """``FOUND`` for windows of ``n`` words; where it ends, 0.06 less for each doubling, as it falls before."""
    longest, least = FOUND[-1]
    return next((rate for most, rate in FOUND if n <= most), max(0.1, least - 0.06 * float(np.ceil(np.log2(max(n, longest) / longest)))))


def walks_needed(n: int, recall: float = RECALL) -> int:
    """Walks that find a window of ``n`` words at the largest distance with probability ``recall``."""
    return SPARE + int(np.ceil(np.log(1 - recall) / np.log1p(-found_rate(n))))


def allowed(n: int, max_edit: float = MAX_EDIT) -> int:
    return int(np.floor(max_edit * n + 1e-9))


def gram_size(n: int, k: int) -> int:
    """The largest q up to 3 of which a window within k edits keeps at least one q-gram; for a window that may keep no word
    at all there is none (0)."""
    return next((q for q in (3, 2, 1) if n - q + 1 - k * q >= 1), 0)


class Walks:
    """The random choices of the embedding and of the sampling, the same in every process."""

    def __init__(self, sizes: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        longest = int(sizes.max(initial=1))
        self.walks = np.zeros(longest + 1, np.int64)  # by size
        for n in np.unique(sizes):
            self.walks[n] = walks_needed(int(n))
        most = int(self.walks.max())
        self.odds = rng.integers(0, 1 << 63, (most, STRETCH * longest), dtype=U) * U(2) + U(1)
        self.places = rng.random((most, KEYS, SAMPLES))

    def keys(self, windows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table the rows of windows ``[rows, longest]`` whose size takes that walk, and their keys (sizes are mixed
        in)."""
        longest = windows.shape[1]
        flat = np.append(windows.reshape(-1), U(0))
        for w in range(len(self.odds)):
            rows = np.flatnonzero(self.walks[sizes] > w)
            own, base = sizes[rows], rows * longest
            steps = STRETCH * int(own.max(initial=0))
            emitted = np.empty((steps, len(rows)), U)
            at = np.zeros(len(rows), np.int64)
            for j in range(steps):
                word = flat[np.where(at < own, base + at, len(flat) - 1)]
                emitted[j] = word
                at += (mix(word * self.odds[w, j]) >> U(63)).astype(np.int64)
            for k in range(KEYS):
                h = mix(own.astype(U) + U(1000 * (w * KEYS + k)))
                for place in self.places[w, k]:
                    h = mix(h * U(31) + emitted[(place * STRETCH * own).astype(np.int64), np.arange(len(rows))])
                yield rows, h


def edit_distances(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Word edit distances of the rows of ``a`` and ``b``, the first ``sizes`` words of each; all rows step by step together."""
    rows, longest = a.shape
    d, out = np.broadcast_to(np.arange(longest + 1), (rows, longest + 1)).astype(np.int32), np.zeros(rows, np.int32)
    ramp = np.arange(longest + 1, dtype=np.int32)
    for i in range(1, int(sizes.max(initial=0)) + 1):
        new = np.empty_like(d)
        new[:, 0] = i
        new[:, 1:] = np.minimum(d[:, :-1] + (b != a[:, i - 1 : i]), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - ramp, axis=1) + ramp  # insertions: a running minimum
        here = sizes == i
        out[here] = d[here, i]
    return out


class Items:
    """A block of benchmark items made ready for the search."""

    def __init__(self, ids: list, texts: list[str | None], max_edit: float = MAX_EDIT):
        words = split_words(pa.array(texts, pa.string()))
        sizes = words.counts()
        keep = np.flatnonzero(sizes > 0)
        self.ids, self.sizes = [ids[i] for i in keep], sizes[keep]
        self.longest = int(self.sizes.max(initial=0))
        self.words = np.zeros((len(keep), self.longest), U)
        for r, i in enumerate(keep):
            self.words[r, : sizes[i]] = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        self.edits = np.array([allowed(int(n), max_edit) for n in self.sizes], np.int64)
        self.q = np.array([gram_size(int(n), int(k)) for n, k in zip(self.sizes, self.edits, strict=True)], np.int64)
        self.least = self.sizes - self.q + 1 - self.edits * self.q
        self.grams = {}
        for q in (1, 2, 3):
            mine = np.flatnonzero(self.q == q)
            if len(mine):
                pairs = np.unique(np.array([(g, r) for r in mine for g in fold(self.words[r, : self.sizes[r]], q)], dtype=[("g", U), ("r", np.int64)]))
                seen = np.zeros(1 << 20, bool)
                seen[(pairs["g"] >> U(44)).astype(np.int64)] = True
                self.grams[q] = (np.ascontiguousarray(pairs["g"]), np.ascontiguousarray(pairs["r"]), seen)
        self.walks = Walks(self.sizes)
        self.tables = []
        if len(keep):
            for rows, key in self.walks.keys(self.words, self.sizes):
                order = np.argsort(key, kind="stable")
                self.tables.append((key[order], rows[order]))

    def starts(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows ``(text, start, size)`` of all texts that share enough q-grams with an item of their size."""
        texts, at, size = [], [], []
        of_word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for q, (grams, owners, seen) in self.grams.items():
            h = fold(hashes, q)
            p = np.flatnonzero(seen[(h >> U(44)).astype(np.int64)])
            p = p[of_word[p] == of_word[p + q - 1]]
            lo, hi = np.searchsorted(grams, h[p], "left"), np.searchsorted(grams, h[p], "right")
            each = hi - lo
            p = np.repeat(p, each)
            item = owners[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
            order = np.lexsort((p, item))
            p, item = p[order], item[order]
            text = of_word[p]
            # `least` hits of one item in one text that fit in a window make a range of starts
            last = np.arange(len(p)) + self.least[item] - 1
            fits = last < len(p)
            first, last = np.flatnonzero(fits), last[fits]
            same = (item[first] == item[last]) & (text[first] == text[last]) & (p[last] - p[first] <= self.sizes[item[first]] - q)
            first, last = first[same], last[same]
            n = self.sizes[item[first]]
            begin, end = bounds[text[first]], bounds[text[first] + 1]
            high = np.maximum(begin, np.minimum(p[first], end - n))
            low = np.minimum(np.maximum(begin, p[last] - (n - q)), high)
            each = high - low + 1
            at.append(np.repeat(low - (np.cumsum(each) - each), each) + np.arange(int(each.sum())))
            texts.append(np.repeat(text[first], each))
            size.append(np.repeat(n, each))
        if not at:
            return (np.zeros(0, np.int64),) * 3
        found = np.unique(np.stack([np.concatenate(texts), np.concatenate(at), np.concatenate(size)], 1), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def cut_out(self, hashes: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = at[:, None] + np.arange(self.longest)[None, :]
        real = place < ends[:, None]
        # the word after a text's end is unlike any other: a hash of the place in the window
        return np.where(real, np.append(hashes, U(0))[np.where(real, place, len(hashes))], mix(np.arange(self.longest, dtype=U) + U(0xD1B54A32D192ED03)))

    def candidates(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(window, item)`` of equal size with an equal key in some table."""
        pairs = []
        for (rows, key), (sorted_, order) in zip(self.walks.keys(windows, sizes), self.tables, strict=True):
            lo, hi = np.searchsorted(sorted_, key, "left"), np.searchsorted(sorted_, key, "right")
            each = hi - lo
            w = np.repeat(rows, each)
            pairs.append(w * len(self.ids) + order[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        w, i = both // max(1, len(self.ids)), both % max(1, len(self.ids))
        same = self.sizes[i] == sizes[w]
        return w[same], i[same]

    def search(self, texts: pa.Array, chunk: int = 1 << 15) -> list[tuple[int, int, int, int]]:
        """``(text, item row, start word, edits)``: for each text and item the closest window, the earliest of those."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        chunk = min(chunk, max(256, (1 << 23) // (STRETCH * max(1, self.longest))))  # what a walk emits, bounded
        for a, b in slices(texts):
            words = split_words(texts.slice(a, b - a))
            text, at, size = self.starts(words.hashes, words.bounds)
            for k in range(0, len(at), chunk):
                own = slice(k, k + chunk)
                windows = self.cut_out(words.hashes, words.bounds[text[own] + 1], at[own])
                w, i = self.candidates(windows, size[own])
                for m in range(0, len(w), chunk):
                    ww, ii = w[m : m + chunk], i[m : m + chunk]
                    d = edit_distances(windows[ww], self.words[ii], self.sizes[ii])
                    for x in np.flatnonzero(d <= self.edits[ii]):
                        t = text[own][ww[x]]
                        key, new = (a + int(t), int(ii[x])), (int(d[x]), int(at[own][ww[x]] - words.bounds[t]))
                        if key not in best or new < best[key]:
                            best[key] = new
        return [(t, i, start, d) for (t, i), (d, start) in best.items()]


def _search(shared, id_type: pa.DataType | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _prepared(shared)
        for batch in batches:
            found = items.search(batch.column(1)) if len(items.ids) else []
            t, i, start, d = (np.array([f[k] for f in found], np.int64) for k in range(4))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(t)), pa.array([items.ids[k] for k in i], pa.from_numpy_dtype(np.int64) if id_type is None else id_type), pa.array(start), pa.array(items.sizes[i] if len(i) else i), pa.array(d)],
                names=["doc_id", "item_id", "start_word", "n_words", "edits"],
            )

    return run


_READY: dict = {}


def _prepared(shared) -> Items:
    """A worker prepares a block of items once."""
    key, *block = shared.value
    if key not in _READY:
        _READY.clear()
        _READY[key] = Items(*block)
    return _READY[key]


def leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, edits``: for each document and item within reach, the closest window."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, n_words long, edits long"
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    rows, out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), None

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [r[0] for r in block], [r[1] for r in block], max_edit))
        return rows.mapInArrow(_search(shared, item_type), schema)

    block, size = [], 0
    for r in items.toLocalIterator():  # one partition at a time; a block leaves the driver once it is broadcast
        block.append(r)
        size += len(r[1].split())
        if size >= block_words:
            found = search(block)
            out, block, size = found if out is None else out.unionAll(found), [], 0
    if block or out is None:
        found = search(block)
        out = found if out is None else out.unionAll(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns."""
    key = document_key(id_col, text_col).alias("key")
    bad = leaks(docs.select(key, F.col(text_col).alias("text")), benchmark, max_edit, "key", "text").select(F.col("doc_id").alias("key")).distinct()
    # rows travel as one struct, so that no column of theirs can clash with the key
    return docs.select(F.struct("*").alias("row"), key).join(bad, "key", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
