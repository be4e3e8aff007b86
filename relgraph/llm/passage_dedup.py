"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a text's content selects them: at the minimisers of its word 10-grams in windows of
``MIN_WORDS - GRAM + 1`` grams, of which any passage of ``MIN_WORDS`` words has one, at the same place in every copy.
Suffixes whose first gram occurs only once cannot be in a repeated passage and go after a map-side combined count. Of the
others, the words to the right (the suffix as far as a passage through the minimiser can reach) and to the left are kept.
They are sorted over all partitions by the words to the right, neighbours are compared, and each match is extended to the
right and to the left; a match of ``MIN_WORDS`` words or more marks both places. Longer passages are the union of
overlapping marks, as minimisers lie less than a window apart.

Neighbours alone miss copies that others part in the order. No two suffixes share more words to the right than one of them
does with a neighbour, so what may be missed is known: the windows of ``MIN_WORDS`` words through a minimiser that a
neighbour's match allows on the right and that the suffix before does not share. Those are grouped by their hash: on the
spot where all suffixes of a gram are at hand, else (a gram at the end of a partition, or of more than ``BLOCK`` suffixes)
over all partitions. Nothing depends on where a batch or a partition ends.

The sort is by range with ties parted by further words, and the rows of a gram that many suffixes begin with (a text that
repeats one word has it at every place) are dealt over many tasks where they meet their count, so no key meets in one task.

Defined results: null and empty texts have no passage; repeated rows are documents like others, so a text of ``MIN_WORDS``
words or more that occurs twice is marked whole in both; a passage repeated within one document counts; an empty table gives
an empty result; other columns are ignored. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, partitions, read, spread_join
from .words import _BASE, U, fold, mix, slices, split_words

MIN_WORDS, GRAM = 50, 10
#: Suffixes of one gram worked on together; the windows of a gram with more are grouped over all partitions.
BLOCK = 1 << 14


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the leftmost smallest value of some ``window`` consecutive ones."""
    n = len(grams)
    if n < window:
        return np.zeros(0, np.int64)
    value, place, wide = grams, np.arange(n), 1
    while wide < window:  # minima of windows of doubling width
        step = min(wide, window - wide)
        a, b = value[: len(value) - step], value[step:]
        later = b < a
        value, place, wide = np.where(later, b, a), np.where(later, place[step:], place[: len(place) - step]), wide + step
    return np.unique(place)


def _selected(texts: pa.Array, gram: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(text, places, gram hashes, word hashes)`` of each text with a minimiser; places count words of the text."""
    for a, b in slices(texts):
        words = split_words(texts.slice(a, b - a))
        grams = fold(words.hashes, gram)
        for i in range(b - a):
            lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
            if hi - lo >= least:
                own = grams[lo : hi - gram + 1]
                at = minimisers(own, least - gram + 1)
                yield a + i, at, own[at], words.hashes[lo:hi]


def _keys(gram: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for i, places, grams, _ in _selected(batch.column(1), gram, least):
                rows.append(np.full(len(places), i))
                at.append(places)
                keys.append(grams)
            yield pa.record_batch([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32))], names=["uid", "key", "at"])

    return run


def _contexts(gram: int, least: int):
    """The words right and left of each place asked for, as big-endian 32-bit hashes, which sort as bytes do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, text = batch.column(2).to_pylist(), batch.column(1)
            for a, b in slices(text):
                words = split_words(text.slice(a, b - a))
                short = (words.hashes >> U(32)).astype(">u4")
                rows, at, right, left = [], [], [], []
                for i in range(b - a):
                    own = short[int(words.bounds[i]) : int(words.bounds[i + 1])]
                    back = own[::-1]
                    for p in wanted[a + i]:
                        rows.append(a + i)
                        at.append(p)
                        right.append(own[p : p + least].tobytes())
                        left.append(back[len(own) - p : len(own) - p + least - gram].tobytes())
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(right, pa.binary()), pa.array(left, pa.binary())], names=["uid", "at", "suffix", "before"])

    return run


def matrix(values: list[bytes], words: int, filler: int) -> np.ndarray:
    """Contexts as rows of words; ``filler + row`` after the end, which equals nothing in another row."""
    lengths = np.array([len(v) // 4 for v in values], np.int64)
    out = np.repeat((filler + np.arange(len(values), dtype=np.int64))[:, None], words, 1)
    real = np.arange(words)[None, :] < lengths[:, None]
    out[real] = np.frombuffer(b"".join(values), ">u4").astype(np.int64)
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first words the rows of ``a`` and ``b`` share."""
    same = a == b
    return np.where(same.all(1), a.shape[1], same.argmin(1)) if len(a) else np.zeros(0, np.int64)


def window_hashes(right: np.ndarray, left: np.ndarray, row: np.ndarray, x: np.ndarray, least: int) -> np.ndarray:
    """Hashes of windows of ``least`` words with ``x`` words left of the minimiser of ``row``; ``x`` is mixed in, so windows of
    one place through two minimisers are not taken for two."""
    words = np.concatenate([left[:, ::-1], right], 1).astype(U)
    sums, far = np.zeros((len(words), words.shape[1] + 1), U), U(1)
    for k in range(words.shape[1]):
        sums[:, k + 1] = sums[:, k] * _BASE + words[:, k]
    for _ in range(least):
        far = far * _BASE
    begin = left.shape[1] - x
    return mix(mix(sums[row, begin + least] - sums[row, begin] * far) + x.astype(U))


def _compare(gram: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows come sorted by suffix. They are worked on in whole grams; the first and last gram may go on in
        another partition, and one of more than ``most`` rows is not held: the windows of those are given out."""

        def marks(block: pa.Table, whole: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
            """``whole``: rows all of whose gram's suffixes are in the block."""
            suffix, before = block["suffix"].to_pylist(), block["before"].to_pylist()
            right, left = matrix(suffix, least, 1 << 33), matrix(before, least - gram, 1 << 33)
            at, n = block["at"].to_numpy().astype(np.int64), len(block)
            r, l = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # shared with the row before
            r[1:n], l[1:n] = common(right[:-1], right[1:]), common(left[:-1], left[1:])
            hit = r + l >= least
            ahead, back = np.where(hit, r, 0), np.where(hit, l, 0)
            ahead, back = np.maximum(ahead[:-1], ahead[1:]), np.maximum(back[:-1], back[1:])
            # windows by the number x of words left of the minimiser
            x = np.arange(least - gram + 1)[None, :]
            reach = np.maximum(r[:-1], r[1:])
            reach[[k for k in (0, n - 1) if not whole[k]]] = least  # a neighbour is elsewhere
            has_left, has_right = (np.array([len(v) // 4 for v in values], np.int64) for values in (before, suffix))
            may = (x <= has_left[:, None]) & (least - x <= np.minimum(reach, has_right)[:, None])
            shared = (least - x <= r[:-1, None]) & (x <= l[:-1, None])
            after = (least - x <= r[1:, None]) & (x <= l[1:, None])
            left_open = (may & ~shared & ~after).any(1) | ~whole
            asked = np.zeros(int(grams[-1]) + 1, bool)
            asked[grams[left_open]] = True
            asked = asked[grams] & ((np.bincount(grams)[grams] > 2) | ~whole)  # two are each other's neighbours
            row, back_by = np.nonzero(may & ~shared & asked[:, None])
            hashes = window_hashes(right, left, row, back_by, least) if len(row) else np.zeros(0, U)
            here = whole[row]
            _, which, count = np.unique(hashes[here], return_inverse=True, return_counts=True)
            again = count[which] > 1
            np.maximum.at(back, row[here][again], back_by[here][again])
            np.maximum.at(ahead, row[here][again], least - back_by[here][again])
            # all of a place's windows hold its gram, so they are one stretch
            marked = np.flatnonzero(ahead)
            out, out_x = row[~here], back_by[~here]
            rows = np.concatenate([marked, out])
            begin = np.concatenate([at[marked] - back[marked], at[out] - out_x])
            end = np.concatenate([at[marked] + ahead[marked], at[out] - out_x + least])
            window = pa.concat_arrays([pa.nulls(len(marked), pa.int64()), pa.array(hashes[~here].view(np.int64))])
            return pa.record_batch([block["uid"].combine_chunks().take(pa.array(rows)), pa.array(begin), pa.array(end), window], names=["uid", "begin", "end", "window"])

        def numbered(suffixes: list[bytes]) -> np.ndarray:
            heads = [v[: 4 * gram] for v in suffixes]
            return np.cumsum([0] + [a != b for a, b in zip(heads, heads[1:], strict=False)])

        held, size, head = [], 0, None  # the rows of the last gram so far
        cut_gram = None  # the gram some rows of which are elsewhere
        for batch in batches:
            if not len(batch):
                continue
            first, last = (batch.column(2)[k].as_py()[: 4 * gram] for k in (0, len(batch) - 1))
            if cut_gram is None:
                cut_gram = first
            held.append(batch)
            size += len(batch)
            if not (first == last and head in (None, first)):
                table = pa.Table.from_batches(held).combine_chunks()
                suffix = table["suffix"].to_pylist()
                grams = numbered(suffix)
                done = int(np.searchsorted(grams, grams[-1]))
                opened = int(np.searchsorted(grams, 1)) if suffix[0][: 4 * gram] == cut_gram else 0
                if done:
                    yield marks(table.slice(0, done).combine_chunks(), np.arange(done) >= opened, grams[:done])
                held, size = table.slice(done).combine_chunks().to_batches(), len(table) - done
            head = last
            if size > most:
                table, cut_gram = pa.Table.from_batches(held).combine_chunks(), last
                yield marks(table, np.zeros(size, bool), np.zeros(size, np.int64))
                held, size = [], 0
        if size:
            yield marks(pa.Table.from_batches(held).combine_chunks(), np.zeros(size, bool), np.zeros(size, np.int64))

    return run


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, start_word, end_word, n_words``: the longest stretches of each document all of which is in passages of
    ``least`` words or more that occur elsewhere too (in another document or another place)."""
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), key.alias("uid"), F.col(text_col).alias("text")).filter("text is not null")
    # repeated rows share a uid: the second one's suffixes stand beside the first one's
    places = cut(texts.select("uid", "text").mapInArrow(_keys(gram, least), "uid long, key long, at int"))
    repeated = cut(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    wanted = cut(spread_join(places, repeated, "key", "n", places.count()).select("uid", "at").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("at")).alias("places")))
    contexts = texts.select("uid", "text").join(wanted, "uid").select("uid", "text", "places").mapInArrow(_contexts(gram, least), "uid long, at int, suffix binary, before binary")
    ordered = contexts.repartitionByRange(partitions(spark), "suffix", "before", "uid", "at").sortWithinPartitions("suffix", "before", "uid", "at")
    compared = cut(ordered.mapInArrow(_compare(gram, least, block), "uid long, begin long, end long, window long"))
    asked = compared.filter("window is not null")
    again = asked.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    marks = compared.filter("window is null").select("uid", "begin", "end").unionAll(asked.join(again, "window").select("uid", "begin", "end"))
    spans = marks.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("marks"))
    merged = F.aggregate(
        "marks",
        F.array().cast("array<struct<begin:bigint,end:bigint>>"),
        lambda acc, m: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= m["begin"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], m["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(m["begin"].alias("begin"), m["end"].alias("end"))))),
    )
    whole = spans.select("uid", F.explode(merged).alias("s")).select("uid", "s.begin", "s.end")
    return texts.select("uid", "doc_id").join(whole, "uid").select("doc_id", F.col("begin").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("begin")).alias("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
