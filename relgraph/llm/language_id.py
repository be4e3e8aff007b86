"""Language identification by a bidirectional GRU over bytes.

The network reads UTF-8 bytes, in segments of ``SEGMENT`` bytes that begin with a fresh state, and gives every byte position
a distribution over the languages; a document's distribution is the mean over all its positions. It is trained in numpy by
backpropagation through time, in one task on an executor, on a bounded sample of rows outside the held-out fifth: whole texts,
segments of which are drawn at random in each step. Of more than ``CLASSES`` languages a step draws that many and tells these
apart: the softmax over them is the model's distribution given that one of them is meant, so no correction is needed. Thousands
of languages want a larger ``size`` and more ``steps``; memory follows the languages, not languages times positions.

Defined results: a text that is null or has no letter is ``und`` with score 0; any other text gets a learned language, and
the score is its pooled probability; repeated rows are scored each; a null ``doc_id`` is not held out; without any labelled
row everything is ``und``; an empty table gives an empty result; other columns are ignored. Whole texts are read. More than
``MOST_LANGS`` distinct languages raise a ``ValueError``.
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
from .words import slices, text_bytes

SIZE = 8
SEGMENT = 64
BATCH = 2048
#: Rows of a language in the training sample, their characters together, and languages up to which that holds; of more
#: languages, all are learned, from fewer rows and characters each.
SAMPLE_EACH, SAMPLE_CHARS, FULL_LANGS = 600, 3_000_000, 100
STEPS, RATE, TRAIN_BATCH = 260, 0.01, 192
#: Languages told apart in one training step; numbers held at once while scoring; languages beyond which fitting raises, as the
#: driver holds their names and counts.
CLASSES, CELLS, MOST_LANGS = 128, 1 << 24, 1 << 16
PAD = 256


def segments(data: np.ndarray, offsets: np.ndarray, steps: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """All bytes cut into segments of ``steps`` (``[segments, steps]``, padded) and the text of each segment."""
    lengths = np.diff(offsets)
    each = -(-lengths // steps)
    first = np.cumsum(each) - each
    out = np.full(int(each.sum()) * steps, PAD, np.int16)
    out[np.arange(len(data)) + np.repeat(first * steps - offsets[:-1], lengths)] = data
    return out.reshape(-1, steps), np.repeat(np.arange(len(lengths)), each)


def train(rows: list[tuple[str, str]], langs: list[str], size: int = SIZE, steps: int = STEPS, seed: int = 0) -> dict[str, np.ndarray]:
    """Fit the network on ``(text, language)`` rows; every position of a segment is labelled with its text's language."""
    rng, place = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}
    data, offsets = text_bytes(pa.array([t for t, _ in rows], pa.string()))
    x, of = segments(data, offsets)
    y = np.array([place[k] for _, k in rows], np.int64)[of]
    order = np.argsort(y, kind="stable")
    learned, firsts = np.unique(y[order], return_index=True)
    by_label = dict(zip(learned.tolist(), np.split(order, firsts[1:]), strict=True))
    unit = lambda *shape: rng.normal(0, 1 / np.sqrt(size), shape).astype(np.float32)
    p = {f"w{d}": rng.normal(0, 0.3, (PAD + 1, 3, size)).astype(np.float32) for d in "fb"} | {f"u{d}": unit(3, size, size) for d in "fb"}
    p |= {f"v{d}": unit(size, len(langs)) for d in "fb"} | {"c": np.zeros(len(langs), np.float32)}
    adam = gru.Adam(p, RATE)
    for step in range(steps):
        adam.rate = RATE * (1 - step / steps)
        # the labels of the step: all of them (with those no row is of), or as many as are told apart at once
        told = np.arange(len(langs)) if len(learned) <= CLASSES else np.sort(rng.choice(learned, CLASSES, replace=False))
        drawn = learned if len(learned) <= CLASSES else told
        pick = np.concatenate([rng.choice(by_label[k], TRAIN_BATCH // len(drawn) + 1) for k in drawn.tolist()])
        xs, ys = x[pick].T.astype(np.int64), np.searchsorted(told, y[pick])
        real = (xs != PAD).astype(np.float32)[..., None]
        g = {d: p[f"w{d}"][xs] for d in "fb"}
        h, kept = {}, {}
        for d in "fb":
            g[d][xs == PAD] = _PAD_GATES(size)
            h[d], kept[d] = gru.forward(g[d], p[f"u{d}"], d == "b")
        v = {d: p[f"v{d}"][:, told] for d in "fb"}
        logits = h["f"] @ v["f"] + h["b"] @ v["b"] + p["c"][told]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        prob[:, np.arange(len(ys)), ys] -= 1
        dl = (prob * real / real.sum()).astype(np.float32)
        grads = {k: np.zeros_like(p[k]) for k in ("c", "vf", "vb")}
        grads["c"][told] = dl.sum((0, 1))
        for d in "fb":
            grads[f"v{d}"][:, told] = np.einsum("tbh,tbc->hc", h[d], dl)
            dg, grads[f"u{d}"] = gru.backward(dl @ v[d].T, kept[d], p[f"u{d}"], d == "b")
            dw = np.zeros_like(p[f"w{d}"])
            order = np.argsort(xs, axis=None, kind="stable")
            flat, keys = dg.reshape(-1, 3 * size)[order], xs.reshape(-1)[order]
            firsts = np.flatnonzero(np.diff(keys, prepend=-1))
            dw.reshape(PAD + 1, -1)[keys[firsts]] = np.add.reduceat(flat, firsts)
            grads[f"w{d}"] = dw
        adam.step(grads)
    for d in "fb":
        p[f"w{d}"][PAD] = _PAD_GATES(size)
    return p


def _PAD_GATES(size: int) -> np.ndarray:
    """Input gates under which a state stays as it is."""
    out = np.zeros((3, size), np.float32)
    out[1] = 40.0
    return out


def probabilities(model: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """``[texts, languages]``: the mean over all positions of the labels' distributions; zeros for an empty text."""
    langs = len(model["c"])
    out = np.zeros((len(texts), langs))
    tables = {d: gru.folded(model[f"w{d}"], model[f"u{d}"]) for d in "fb"}
    each = max(1, min(BATCH, CELLS // (SEGMENT * langs)))
    for a, b in slices(texts):
        data, offsets = text_bytes(texts.slice(a, b - a))
        x, of = segments(data, offsets)
        for k in range(0, len(x), each):
            xs = np.ascontiguousarray(x[k : k + each].T)
            ahead = np.empty((*xs.shape, langs), np.float32)
            for t, y in gru.scan(*tables["f"], xs, model["vf"]):
                ahead[t] = y
            ahead += model["c"]
            got = np.zeros((xs.shape[1], langs), np.float32)
            for t, y in gru.scan(*tables["b"], xs, model["vb"], reverse=True):
                y += ahead[t]
                y -= y.max(1, keepdims=True)
                np.exp(y, out=y)
                y *= ((xs[t] != PAD) / y.sum(1))[:, None]
                got += y
            own = of[k : k + each]
            firsts = np.flatnonzero(np.diff(own, prepend=-1))
            out[a + own[firsts]] += np.add.reduceat(got.astype(np.float64), firsts)
        out[a:b] /= np.maximum(np.diff(offsets), 1)[:, None]
    return out


def likeliest(model: dict[str, np.ndarray], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's likeliest language, by number, and its probability."""
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    each = max(1, CELLS // len(model["c"]))
    for a in range(0, len(texts), each):
        p = probabilities(model, texts.slice(a, each))
        best[a : a + each], score[a : a + each] = p.argmax(1), p.max(1)
    return best, score


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", size: int = SIZE, steps: int = STEPS) -> tuple[dict[str, np.ndarray] | None, list[str]]:
    """The model and its languages, learned from rows with text and language that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label")).filter("text is not null and label is not null").filter(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("label").count().limit(MOST_LANGS + 1).toArrow()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} distinct values of {lang_col}")
    langs = sorted(counts["label"].to_pylist())
    if not langs:
        return None, langs
    share = max(1.0, len(langs) / FULL_LANGS)
    known = F.broadcast(docs.sparkSession.createDataFrame(counts).withColumnRenamed("count", "n"))  # MOST_LANGS rows at most
    sample = chosen_rows(rows.select("text", "label", F.xxhash64("doc_id", "text").alias("uid")).join(known, "label"), "label", "n", max(20, int(SAMPLE_EACH / share)), F.col("uid"))
    return fit_in_task(sample, lambda found: train(found, langs, size, steps), int(SAMPLE_CHARS / share)), langs


def identify(docs: DataFrame, model: dict[str, np.ndarray] | None, langs: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, langs))  # its size follows the languages, MOST_LANGS at most
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, langs = shared.value
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            best, score = np.full(len(letters), len(langs)), np.zeros(len(letters))
            if model is not None and len(letters):
                best, score = likeliest(model, batch.column(1))
                best, score = np.where(letters, best, len(langs)), np.where(letters, score, 0.0)
            yield pa.record_batch([batch.column(0), batch.column(3), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model, langs = fit(docs)
    return identify(docs, model, langs)
