"""The recurrent networks: gradients, inference, held-out accuracy, odd inputs; and the pipeline."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relgraph.llm import gru, language_id, toxicity
from relgraph.llm.words import mix, split_words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("reverse", [False, True])
def test_gradients(reverse):
    rng = np.random.default_rng(0)
    g, u, pull = (rng.normal(0, 0.5, s).astype(np.float32) for s in ((5, 3, 3, 4), (3, 4, 4), (5, 3, 4)))
    loss = lambda: float((gru.forward(g, u, reverse)[0] * pull).sum())
    _, kept = gru.forward(g, u, reverse)
    dg, du = gru.backward(pull, kept, u, reverse)
    for array, grad in ((g, dg), (u, du)):
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(12)]:
            was, e = array[at], 1e-2
            array[at] = was + e
            up = loss()
            array[at] = was - e
            down = loss()
            array[at] = was
            assert grad[at] == pytest.approx((up - down) / (2 * e), abs=2e-2)


def test_scan_equals_forward():
    rng = np.random.default_rng(1)
    table, u = rng.normal(size=(50, 3, 6)).astype(np.float32), rng.normal(size=(3, 6, 6)).astype(np.float32)
    x = rng.integers(0, 50, (9, 17))
    for reverse in (False, True):
        want, _ = gru.forward(table[x], u, reverse)
        for t, got in gru.scan(*gru.folded(table, u), x, np.eye(6, dtype=np.float32), reverse):
            assert np.allclose(got, want[t], atol=1e-5)


def test_segments_cover_all_bytes():
    data, offsets = np.arange(200, dtype=np.uint8), np.array([0, 0, 1, 65, 129, 200])
    x, of = language_id.segments(data, offsets, 64)
    assert x[x != language_id.PAD].tolist() == data.tolist() and of.tolist() == [1, 2, 3, 4, 4]


def test_windows_cover_all_words():
    bounds = np.array([0, 0, 1, 49, 98, 500])
    starts, sizes, of = toxicity.windows(bounds)
    for i in range(5):
        own = of == i
        assert own.any()
        covered = {w for s, n in zip(starts[own], sizes[own], strict=True) for w in range(s, s + n)}
        assert covered == set(range(bounds[i], bounds[i + 1]))


def speech(rng, sounds, words):
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(1, 4))) for _ in range(words))


SOUNDS = {"aa": ["ka", "lo", "mi"], "bb": ["tsch", "ung", "er"], "cc": ["é", "ou", "eaux"]}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_id(spark):
    rng = random.Random(0)
    rows = [(i, speech(rng, SOUNDS[k], rng.randrange(3, 60)), k) for i in range(240) for k in [rng.choice(list(SOUNDS))]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, speech(rng, SOUNDS["cc"], 20000), None), (None, "kalomi kalo", None), (5, "tsch", "aa"), (5, "tsch", "aa")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model, langs = language_id.fit(df, steps=80)
    got = language_id.identify(df, model, langs).collect()
    assert len(got) == len(rows) and langs == ["aa", "bb", "cc"]
    right = [r.lang_pred == dict((i, k) for i, _, k in rows)[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean(right) > 0.95
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "cc" and by[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    assert language_id.identify(df.limit(0), model, langs).count() == 0
    nothing = language_id.fit(df.filter("lang is null and doc_id is null and text is null"))
    assert {r.lang_pred for r in language_id.identify(df, *nothing).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        ws, bad = speech(rng, ["ka", "lo", "mi", "ru", "te"], rng.randrange(5, 250)).split(), i % 4 == 0
        if bad:
            for _ in range(rng.randrange(1, 5)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["zorg", "blaft", "quix"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "?!"), (903, "kalo " * 30000), (None, "zorg"), (3, "kalo"), (3, "kalo")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(df, toxicity.fit(df, known, steps=120)).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 60 and np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_documents(df.limit(0), 0.0).count() == 0
    assert {r.score for r in toxicity.score_documents(df, toxicity.fit(df, known.filter("toxic = 0"))).collect()} == {0.0}


def test_features_group_grams_by_word():
    words = split_words(pa.array(["ab cde ab", "cde x"]))
    number, rows, grams, begins = toxicity.features(words)
    assert len(rows) == 3 and number.tolist()[0] == number.tolist()[2] and number.tolist()[1] == number.tolist()[3]
    assert (np.diff(np.append(begins, len(grams))) > 0).all()


def test_long_clean_texts_stay_clean():
    """Rare words, ever new ones, must not add up to a toxic text, however long it is."""
    rng = random.Random(3)
    sounds = ["ka", "lo", "mi", "ru", "te", "sa", "po", "ne", "vi", "du"]
    rows = []
    for i in range(400):
        ws = ["".join(rng.choice(sounds) for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(20, 200))]
        if i % 5 == 0:
            ws.insert(rng.randrange(len(ws)), rng.choice(["zorg", "blaft", "quix"]))
        rows.append((" ".join(ws), int(i % 5 == 0)))
    model = toxicity.train(rows, 0.2, steps=200)
    clean = [" ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(2, 6))) for _ in range(6000)) for _ in range(10)]
    bad = [c[:20000] + " blaft " + c[20000:] for c in clean]
    assert (toxicity.scores(model, pa.array(clean)) < 0.5).all()
    assert (toxicity.scores(model, pa.array(bad)) >= 0.5).all()


def slow_states(gates, u):
    """States of one direction over a list of input gates ``[3, H]``, one step and one unit at a time, in float64."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    size, h, out = u.shape[1], [0.0] * u.shape[1], []
    for g in gates:
        a = [[sum(h[i] * float(u[k][i][j]) for i in range(size)) for j in range(size)] for k in range(3)]
        r, z = ([sig(float(g[k][j]) + a[k][j]) for j in range(size)] for k in (0, 1))
        n = [math.tanh(float(g[2][j]) + r[j] * a[2][j]) for j in range(size)]
        h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(size)]
        out.append(np.array(h))
    return out


def slow_both(m, gates):
    """States of both directions at each step."""
    return slow_states(gates["f"], m["uf"]), slow_states(gates["b"][::-1], m["ub"])[::-1]


def slow_language(m, text):
    data, total = text.encode(), 0.0
    for a in range(0, len(data), language_id.SEGMENT):
        part = data[a : a + language_id.SEGMENT]
        ahead, back = slow_both(m, {d: [m[f"w{d}"][c] for c in part] for d in "fb"})
        for x, y in zip(ahead, back, strict=True):
            e = np.exp(x @ m["vf"] + y @ m["vb"] + m["c"])
            total = total + e / e.sum()
    return total / len(data)


def slow_toxicity(m, text):
    words = text_words(text)
    of_word, of_gram = (dict(zip(m[k].tolist(), range(len(m[k])), strict=True)) for k in ("words", "grams"))
    vectors = {}
    for w in set(words):
        v = m["word"][of_word.get(int(split_words(pa.array([w])).hashes[0]), -1)].astype(float)
        marked = b"^" + w.encode() + b"$"
        grams = [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        for g in grams:
            h = len(g)
            for c in g:
                h = (h * 257 + c) % 2**64
            v = v + m["gram"][of_gram.get(int(mix(np.array([h], np.uint64))[0]), -1)].astype(float) / math.sqrt(len(grams))
        vectors[w] = v
    best = -math.inf
    for a in range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE):
        own = words[a : a + toxicity.WINDOW]
        ahead, back = slow_both(m, {d: [(vectors[w] @ m[f"w{d}"] + m[f"c{d}"]).reshape(3, -1) for w in own] for d in "fb"})
        outs = [x @ m["rf"] + y @ m["rb"] for x, y in zip(ahead, back, strict=True)]
        weights = [math.exp(o[0]) for o in outs]
        best = max(best, sum(w * o[1] for w, o in zip(weights, outs, strict=True)) / sum(weights) + float(m["b"][0]) if own else float(m["b"][0]))
    return 1 / (1 + math.exp(-(m["scale"][0] * best + m["scale"][1])))


def text_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_queries_equal_a_slow_forward_pass(spark, monkeypatch):
    """Both queries whole, with the model each has fitted, against plain loops over units, positions and windows."""
    fitted = {}
    for module, steps in ((toxicity, 40), (language_id, 20)):
        own = module.fit
        monkeypatch.setattr(module, "fit", lambda *a, own=own, module=module, steps=steps: fitted.setdefault(module, own(*a, steps=steps)))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = sorted((i for i in texts if all(c.isascii() or c.isalpha() for c in texts[i])), key=lambda i: len(texts[i]))
    toxic, lang = ({r.doc_id: r for r in module.query(spark, SF).collect()} for module in (toxicity, language_id))
    assert toxic.keys() == lang.keys() == texts.keys()
    for i in [k for k in short if texts[k].strip()][:12] + short[-1:]:
        if len(texts[i]) < 4000:
            assert toxic[i].score == pytest.approx(slow_toxicity(fitted[toxicity], texts[i]), abs=2e-3)
            model, langs = fitted[language_id]
            want = slow_language(model, texts[i])
            assert lang[i].score == pytest.approx(want.max(), abs=2e-3)
            assert lang[i].lang_pred == langs[int(want.argmax())] or np.sort(want)[-1] - np.sort(want)[-2] < 4e-3


def test_pipeline(spark, monkeypatch):
    """Every stage and ``run`` itself, with rows of every odd kind and columns named like the stages' own."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    monkeypatch.setattr(toxicity, "STEPS", 60)
    monkeypatch.setattr(toxicity.fit, "__defaults__", ("text", "toxic", "doc_id", 60))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "null id", "en", "src0", 7), (None, "null id", "en", "src0", 7)], docs.schema)
    source = docs.unionAll(extra)
    docs = source.select("*", *[F.lit(1).alias(c) for c in ("key", "row", "id", "own", "digest", "__key", "score", "uid", "size", "count")])
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "mixing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
            assert docs.exceptAll(before).isEmpty()
        if name == "exact_dedup":
            texts = [r.text or "" for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts)) == before.select("text").na.fill("").distinct().count()
        docs = docs.cache()
    assert docs.agg({"copies": "max"}).first()[0] <= 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.limit(0), SF).count() == 0
    want = sorted(str(tuple(r)) for r in docs.collect())
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, sf_dir, table: source if table == "documents" else spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, SF).collect()) == want
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, sf_dir, table: spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0))
    assert corpus_pipeline.run(spark, SF).count() == 0


def test_all_languages_are_learned(spark):
    """Of more languages than have full samples each one can be predicted; the sample is whole rows of each."""
    from pyspark.sql import functions as F

    from relgraph.llm.sampling import chosen_rows

    rows = [(100 * k + j, f"some text {j}", f"l{k:03}") for k in range(130) for j in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, langs = language_id.fit(df, steps=2)
    assert len(langs) == 130 and len(model["c"]) == 130
    got = [{tuple(r) for r in chosen_rows(df.repartition(p).select("doc_id", "text", F.col("lang").alias("label")), "label", {f"l{k:03}": 10 for k in range(130)}, 3, F.col("doc_id")).collect()} for p in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 390


def test_thousands_of_languages(spark):
    """No literal a language in the plan, no cell a language and position in memory; beyond the bound an error is told."""
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), F.pmod("id", F.lit(5000))).alias("lang"))
    model, langs = language_id.fit(df, steps=2)
    assert len(langs) > 4500 and model["vf"].shape[1] == len(langs)  # those that have a row outside the held-out fifth
    got = language_id.identify(df, model, langs)
    assert got.count() == 10_000 and got.filter(~F.col("lang_pred").isin("und") & F.col("score").between(0, 1)).count() == 10_000


def test_more_languages_than_the_bound_raise(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), F.pmod("id", F.lit(9))).alias("lang"))
    with pytest.raises(ValueError, match="distinct values"):
        language_id.fit(df, steps=1)


def test_languages_drawn_by_steps_are_told_apart(monkeypatch):
    """With fewer languages to a step than there are, and scored by few cells, as with all at once."""
    rng = random.Random(3)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    rows = [("".join(rng.choice(alphabets[k]) for _ in range(90)), f"l{k}") for k in range(6) for _ in range(30)]
    langs = [f"l{k}" for k in range(6)]
    monkeypatch.setattr(language_id, "CLASSES", 3)
    model = language_id.train(rows, langs, steps=150)
    texts = pa.array([t for t, _ in rows])
    best, score = language_id.likeliest(model, texts)
    assert np.mean([langs[k] == want for k, (_, want) in zip(best, rows, strict=True)]) > 0.95
    monkeypatch.setattr(language_id, "CELLS", 64 * 6 * 2)
    again = language_id.likeliest(model, texts)
    assert (again[0] == best).all() and np.allclose(again[1], score, atol=1e-5)


def test_samples_are_bounded_and_the_same_on_every_run(spark):
    from pyspark.sql import functions as F

    from relgraph.llm.sampling import chosen_rows, fit_in_task

    rows = [(i, "x" * (i % 50), i % 2) for i in range(4000)] + [(7, "y", 1)] * 4000
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    seen = []
    for p in (1, 6):
        sample = chosen_rows(df.repartition(p), "label", {0: 2000, 1: 6000}, 100, F.col("doc_id"))
        own = fit_in_task(sample, lambda found: {"n": np.array([len(found), *(sum(len(t) for t, k in found if k == j) for j in (0, 1))])}, 1000)
        seen.append((sorted(tuple(r) for r in sample.collect()), own["n"].tolist()))
    assert seen[0] == seen[1] and 100 < len(seen[0][0]) <= 200 and all(n <= 1000 for n in seen[0][1][1:])
    assert fit_in_task(df.limit(0).withColumn("h", F.lit(0)), lambda found: {}, 10) is None
