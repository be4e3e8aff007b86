"""Toxicity by a bidirectional GRU with attention pooling over character and word inputs.

A text's words enter the network as the sum of a word's embedding and the scaled sum of the embeddings of its character (byte)
n-grams with its ends marked. Words and n-grams in at least ``MIN_DOCS`` documents of the training sample have embeddings, kept
by full 64-bit hashes; others enter as zero, so an unknown word is read by the n-grams that are known. All of it is learned
through the network: nothing about labels reaches a score in any other way. Overlapping windows of ``WINDOW`` words, one every
``STRIDE``, each go through the GRU and an attention pooling to a logit; a document's score is that of its worst window. All
windows of the whole text are scored. It is trained in numpy by backpropagation through time, as multiple-instance learning:
a labelled document is a bag of windows and the gradient goes to its windows by their share in the soft maximum. A bag holds
the windows that scored highest when all were last scored, and random ones. Slope and offset of the scores come from a part of
the sample that the network is not trained on.

Training is one task on an executor over a bounded sample: at most ``SAMPLE_EACH`` labelled rows of a kind, whole texts, and
``SAMPLE_CHARS`` characters of a kind together.

Defined results: a text that is null, empty or without words is one empty window and gets the network's base score; repeated
rows are scored each; a null ``doc_id`` is not held out; of several labels of one id the largest counts; without labels of
both kinds every score is 1.0 if all labels are toxic and else 0.0; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .sampling import chosen_rows, fit_in_task, held_out
from .session import read
from .words import U, Words, mix, slices, split_words

SIZE, DIM = 16, 16
WINDOW, STRIDE = 48, 36
GRAMS = (3, 4, 6)
#: Windows, and words, worked on at once.
BATCH, BLOCK = 2048, 4096
#: Labelled rows of a kind in the training sample, and their characters together.
SAMPLE_EACH, SAMPLE_CHARS = 1500, 12_000_000
#: Documents of the sample that a word or an n-gram must be in to have an embedding.
MIN_DOCS = 2
STEPS, RATE, EMBED_RATE, BAGS, BAG_WINDOWS = 300, 0.01, 0.4, 48, 6
#: Steps after which all windows are scored anew; share of words known by their n-grams alone in a step; one row in so many
#: is kept aside for slope and offset.
REFRESH, DROPPED, ASIDE = 40, 0.1, 5


NOTHING = (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's number among the distinct ones; the distinct words' hashes; their n-grams' hashes, one word's after
    another's, and where each word's begin."""
    distinct, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, lengths = words.starts[first], (words.ends - words.starts)[first]
    marked = lengths + 2
    at = np.cumsum(marked) - marked
    data = np.full(int(marked.sum()), 0x5E, np.uint8)
    data[at + marked - 1] = 0x24
    inner = np.arange(int(lengths.sum())) + np.repeat(np.cumsum(lengths) * 0 + at + 1 - (np.cumsum(lengths) - lengths), lengths)
    data[inner] = words.data[np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)]
    of, room = np.repeat(np.arange(len(distinct)), marked), np.repeat(at + marked, marked) - np.arange(len(data))
    rows, owners, wide = [], [], data.astype(U)
    for n in GRAMS:
        keep = np.flatnonzero(room >= n)
        h = np.full(len(keep), U(n), U)
        for k in range(n):
            h = h * U(257) + wide[keep + k]
        rows.append(mix(h))
        owners.append(of[keep])
    owner, grams = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(distinct))
    return number, distinct, grams[order], np.cumsum(counts) - counts


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of texts with the word bounds ``bounds`` begin, their sizes, and the text of each. Every word is in a
    window; a text without words has one empty window."""
    n = np.diff(bounds)
    each = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    of = np.repeat(np.arange(len(n)), each)
    k = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    return bounds[:-1][of] + k * STRIDE, np.minimum(WINDOW, n[of] - k * STRIDE), of


def padded(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pad: int) -> np.ndarray:
    """``[WINDOW, windows]`` word numbers, ``pad`` after a window's end."""
    place = starts[None, :] + np.arange(WINDOW)[:, None]
    real = np.arange(WINDOW)[:, None] < sizes[None, :]
    return np.where(real, np.append(numbers, pad)[np.where(real, place, 0)] if len(numbers) else pad, pad)


def document_counts(doc_of: np.ndarray, number: np.ndarray, n_docs: int, n_words: int, gram_ids: np.ndarray, n_grams: int, begins: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each distinct word and n-gram is. Documents are taken ``block`` at a time, so memory grows with
    the vocabulary only."""
    each = np.diff(np.append(begins, len(gram_ids)))
    of_words, of_grams = np.zeros(n_words, np.int64), np.zeros(n_grams, np.int64)
    for a in range(0, n_docs, block):
        lo, hi = np.searchsorted(doc_of, [a, a + block])
        pairs = np.unique((doc_of[lo:hi] - a) * np.int64(max(1, n_words)) + number[lo:hi])
        doc, word = pairs // max(1, n_words), pairs % max(1, n_words)
        np.add.at(of_words, word, 1)
        n = each[word]
        grams = gram_ids[np.repeat(begins[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        np.add.at(of_grams, np.unique(np.repeat(doc, n) * np.int64(max(1, n_grams)) + grams) % max(1, n_grams), 1)
    return of_words, of_grams


def row_of(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each hash's row in a table with the sorted hashes ``keys``; the row after the last, which is zero, if it lacks it."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, len(keys))


def embed(p: dict, words: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Input vectors of distinct words, given by their hashes and those of their n-grams."""
    if not len(words):
        return np.zeros((0, DIM), np.float32)
    ends = np.append(begins[1:], len(grams))
    out = p["word"][row_of(p["words"], words)].astype(np.float32)
    for a in range(0, len(words), BLOCK):  # a block's n-grams have their vectors at a time
        own = slice(a, a + BLOCK)
        lo, hi = int(begins[a]), int(ends[own][-1])
        vectors = p["gram"][row_of(p["grams"], grams[lo:hi])].astype(np.float32, copy=False)
        out[own] += np.add.reduceat(vectors, begins[own] - lo) / np.sqrt(ends[own] - begins[own])[:, None].astype(np.float32)
    return out


def joined(texts: pa.Array) -> Words:
    """The words of all texts, split a slice at a time so that only the result is held whole."""
    parts, offset, done = [], 0, 0
    bounds = [np.zeros(1, np.int64)]
    for a, b in slices(texts):
        w = split_words(texts.slice(a, b - a))
        parts.append((w.hashes, w.starts + offset, w.ends + offset, w.data))
        bounds.append(w.bounds[1:] + done)
        offset, done = offset + len(w.data), done + len(w.hashes)
    return Words(np.concatenate([q[0] for q in parts]), np.concatenate(bounds), *(np.concatenate([q[k] for q in parts]) for k in (1, 2, 3)))


def _initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    p = {"b": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": f(1 / np.sqrt(DIM), DIM, 3 * SIZE), f"c{d}": np.zeros(3 * SIZE, np.float32), f"u{d}": f(1 / np.sqrt(SIZE), 3, SIZE, SIZE), f"r{d}": f(1 / np.sqrt(SIZE), SIZE, 2)}
    return p


def _descend(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """An Adagrad step on the named rows of an embedding table; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    keys = rows[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    g, at = np.add.reduceat(grads[order], firsts), keys[firsts]
    squares[at] += (g * g).mean(1)
    table[at] -= rate * g / np.sqrt(squares[at] + 1e-8)[:, None]


def _pad_gates() -> np.ndarray:
    out = np.zeros((3, SIZE), np.float32)
    out[1] = 40.0  # a state stays as it is
    return out


def train(rows: list[tuple[str, int]], prior: float, steps: int = STEPS, seed: int = 0, chars: bool = True, attention: bool = True) -> dict[str, np.ndarray]:
    """Fit on ``(text, label)`` rows of both labels; ``prior`` is the share of toxic ones outside the sample. Without ``chars``
    words alone are the input, without ``attention`` a window is the mean of its words' values (for comparison)."""
    rng = np.random.default_rng(seed)
    y = np.array([k for _, k in rows], np.float32)
    texts = pa.array([t for t, _ in rows], pa.string())
    aside = np.zeros(len(rows), bool)
    for k in (0, 1):  # both labels are on both sides where there are rows enough
        own = rng.permutation(np.flatnonzero(y == k))
        aside[own[: len(own) // ASIDE]] = True
    fitted, others = np.flatnonzero(~aside), np.flatnonzero(aside)
    p = _network(texts.take(pa.array(fitted)), y[fitted], steps, rng, chars, attention)
    judged = others if len(set(y[others].tolist())) == 2 else np.arange(len(rows))
    p["scale"] = calibrated(worst_windows(p, texts.take(pa.array(judged))), y[judged], prior)
    return p


def _network(texts: pa.Array, y: np.ndarray, steps: int, rng: np.random.Generator, chars: bool, attention: bool) -> dict[str, np.ndarray]:
    words = joined(texts)
    number, distinct, grams, begins = features(words) if len(words.hashes) else NOTHING
    starts, sizes, of = windows(words.bounds)
    first = np.searchsorted(of, np.arange(len(y) + 1))
    gram_hashes, gram_ids = np.unique(grams, return_inverse=True)
    gram_counts = np.diff(np.append(begins, len(grams)))
    docs_of = document_counts(np.repeat(np.arange(len(y)), words.counts()), number, len(y), len(distinct), gram_ids, len(gram_hashes), begins)
    keys = {"words": distinct[docs_of[0] >= MIN_DOCS], "grams": gram_hashes[docs_of[1] >= MIN_DOCS][: None if chars else 0]}
    p = _initial(rng)
    if not attention:
        p["rf"][:, 0] = p["rb"][:, 0] = 0
    tables = {k: np.concatenate([rng.normal(0, 0.1, (len(keys[f"{k}s"]), DIM)), np.zeros((1, DIM))]).astype(np.float32) for k in ("word", "gram")}
    squares = {k: np.full(len(v), 1e-4, np.float32) for k, v in tables.items()}
    word_row, gram_row = row_of(keys["words"], distinct), row_of(keys["grams"], grams)
    latest = np.zeros(len(starts), np.float32)  # every window's logit when all were last scored
    adam = gru.Adam(p, RATE)
    for step in range(steps):
        adam.rate = RATE * (1 - step / steps)
        if step and step % REFRESH == 0:
            latest = logits_of(p | tables | keys, number, distinct, grams, begins, starts, sizes)
        docs = np.concatenate([rng.choice(np.flatnonzero(y == k), BAGS // 2) for k in (0, 1)])
        pick, bag = [], []
        for i, d in enumerate(docs):
            own = np.arange(first[d], first[d + 1])
            if len(own) > BAG_WINDOWS:
                worst = own[np.argpartition(-latest[own], BAG_WINDOWS // 2)[: BAG_WINDOWS // 2]] if step >= REFRESH else own[:0]
                own = np.unique(np.concatenate([worst, rng.choice(own, BAG_WINDOWS - len(worst), replace=False)]))
            pick.append(own)
            bag += [i] * len(own)
        pick, bag, ys = np.concatenate(pick), np.array(bag), y[docs]
        x = padded(number, starts[pick], sizes[pick], -1)
        real = x >= 0
        used, local = np.unique(x[real], return_inverse=True)
        counts = gram_counts[used]
        gi = np.repeat(begins[used] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        root = np.sqrt(counts)[:, None].astype(np.float32)
        rows = word_row[used]
        rows = np.where(rng.random(len(used)) < DROPPED, len(tables["word"]) - 1, rows)
        sums = np.add.reduceat(tables["gram"][gram_row[gi]], np.cumsum(counts) - counts) if len(used) else np.zeros((0, DIM), np.float32)
        vec = tables["word"][rows] + sums / root
        ids = np.full(x.shape, len(used))
        ids[real] = local
        h, kept, g = {}, {}, {}
        for d in "fb":
            table = np.concatenate([vec @ p[f"w{d}"] + p[f"c{d}"], _pad_gates().reshape(1, -1)]).reshape(-1, 3, SIZE)
            g[d] = table[ids]
            h[d], kept[d] = gru.forward(g[d], p[f"u{d}"], d == "b")
        so = h["f"] @ p["rf"] + h["b"] @ p["rb"]
        s = np.where(real, so[..., 0], -1e9)
        a = np.exp(s - s.max(0)) * real
        a /= np.maximum(a.sum(0), 1e-9)
        logit = (a * so[..., 1]).sum(0) + p["b"]
        top = np.full(len(docs), -1e9, np.float32)
        np.maximum.at(top, bag, logit)
        share = np.exp(logit - top[bag])
        share /= np.bincount(bag, share, len(docs))[bag]
        doc = np.bincount(bag, share * logit, len(docs))
        dd = (gru.sigmoid(doc) - ys) / len(docs)
        dlogit = (dd[bag] * share * (1 + logit - doc[bag])).astype(np.float32)
        ds = a * (so[..., 1] - (a * so[..., 1]).sum(0)) * dlogit * attention
        dso = np.stack([ds, a * dlogit], -1).astype(np.float32)
        by_word = np.argsort(local, kind="stable")
        word_firsts = np.searchsorted(local[by_word], np.arange(len(used)))
        grads, dvec = {"b": np.array([dlogit.sum()], np.float32)}, np.zeros_like(vec)
        for d in "fb":
            grads[f"r{d}"] = np.einsum("tbh,tbk->hk", h[d], dso)
            dg, grads[f"u{d}"] = gru.backward(dso @ p[f"r{d}"].T, kept[d], p[f"u{d}"], d == "b")
            flat = dg.reshape(*x.shape, -1)[real][by_word]
            dtable = np.add.reduceat(flat, word_firsts) if len(used) else np.zeros((0, 3 * SIZE), np.float32)
            grads[f"w{d}"], grads[f"c{d}"] = vec.T @ dtable, dtable.sum(0)
            dvec += dtable @ p[f"w{d}"].T
        adam.step(grads)
        rate = EMBED_RATE * (1 - step / steps)
        _descend(tables["word"], squares["word"], rows, dvec, rate)
        _descend(tables["gram"], squares["gram"], gram_row[gi], np.repeat(dvec / root, counts, axis=0), rate)
        tables["word"][-1] = tables["gram"][-1] = 0
    return p | {k: v.astype(np.float16) for k, v in tables.items()} | keys


def calibrated(logits: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Slope and offset that turn worst-window logits into log odds of the label: logistic regression by Newton's method, the
    sample weighted to the ``prior``, with a slight pull to (1, 0)."""
    x, w = np.stack([logits, np.ones(len(y))], 1), np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    beta, pull = np.array([1.0, 0.0]), np.array([1.0, 0.1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (q - y)) + pull * (beta - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + np.diag(pull), grad)
        beta = beta - np.clip(step, -1, 1)
    return np.array([max(beta[0], 0.05), beta[1]])


def scores(p: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """The calibrated probability of each text, by its worst window."""
    slope, offset = p["scale"]
    return gru.sigmoid(np.clip(slope * worst_windows(p, texts) + offset, -30, 30))


def logits_of(p: dict[str, np.ndarray], number: np.ndarray, distinct: np.ndarray, grams: np.ndarray, begins: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The logit of each window."""
    vec = embed(p, distinct, grams, begins)
    tables = {d: gru.folded(np.concatenate([vec @ p[f"w{d}"] + p[f"c{d}"], _pad_gates().reshape(1, -1)]).reshape(-1, 3, SIZE), p[f"u{d}"]) for d in "fb"}
    logits = np.empty(len(starts), np.float32)
    for k in range(0, len(starts), BATCH):
        x = padded(number, starts[k : k + BATCH], sizes[k : k + BATCH], len(vec))
        ahead = np.empty((*x.shape, 2), np.float32)
        for t, so in gru.scan(*tables["f"], x, p["rf"]):
            ahead[t] = so
        for t, so in gru.scan(*tables["b"], x, p["rb"], reverse=True):
            ahead[t] += so
        s = np.where(x < len(vec), ahead[..., 0], np.float32(-1e9))
        w = np.exp(s - s.max(0)) * (x < len(vec))
        logits[k : k + BATCH] = (w * ahead[..., 1]).sum(0) / np.maximum(w.sum(0), 1e-9) + p["b"]
    return logits


def worst_windows(p: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """The largest logit among each text's windows."""
    out = np.empty(len(texts))
    for a, b in slices(texts):
        words = split_words(texts.slice(a, b - a))
        number, distinct, grams, begins = features(words) if len(words.hashes) else NOTHING
        starts, sizes, of = windows(words.bounds)
        out[a:b] = np.maximum.reduceat(logits_of(p, number, distinct, grams, begins, starts, sizes), np.searchsorted(of, np.arange(b - a)))
    return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", steps: int = STEPS) -> dict[str, np.ndarray] | float:
    """The model learned from labelled rows that are not held out; without both kinds of label, the share of toxic ones."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts:
        return 0.0
    prior = counts.get(1, 0) / sum(counts.values())
    if len(counts) < 2:
        return float(prior == 1.0)
    # the labels are sampled first, so that few rows, whatever the data, are broadcast to meet their texts where these are
    chosen = F.broadcast(chosen_rows(known, "label", counts, SAMPLE_EACH, F.col("doc_id")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    sample = texts.join(chosen, "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))  # one row an id
    model = fit_in_task(sample, lambda rows: train(rows, prior, steps) if len({k for _, k in rows}) == 2 else {"constant": np.array(float(prior >= 0.5))}, SAMPLE_CHARS)
    return 0.0 if model is None else float(model["constant"]) if "constant" in model else model


def score_documents(docs: DataFrame, model: dict[str, np.ndarray] | float, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with the sample's vocabulary, which is bounded
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = np.full(len(batch), model) if isinstance(model, float) else scores(model, batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read(spark, sf_dir, "labels")))
