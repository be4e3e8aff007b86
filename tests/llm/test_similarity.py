"""N-gram join, decontamination and repeated passages against brute force."""

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from relgraph.llm import decontamination, ngram_join, passage_dedup
from relgraph.llm.words import UNSPACED, fold, split_words

DOCS = "doc_id long, text string, size long, cid long, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], DOCS)


def words_of(text):
    out, own = [], ""
    for c in (text or "").lower() + " ":
        alone = any(x <= ord(c) <= y for x, y in UNSPACED) and unicodedata.category(c)[0] in "LMN"
        if unicodedata.category(c)[0] in "LMN" and not alone:
            own += c
            continue
        out += [own] * bool(own) + [c] * alone
        own = ""
    return out


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng, text, edits):
    ws = text.split()
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = f"z{rng.randrange(10**6)}"
    return " ".join(ws)


def test_words():
    texts = ["Ab, cÉ-d\n1", None, "", "x", "  ", "été", "你好，世界。ok今天x", "“Zitat” — x…y", "e\u0301 a😀b 𠀀𠀁", "ก็"]
    got = split_words(pa.array(texts))
    assert got.counts().tolist() == [len(words_of(t)) for t in texts]
    by = defaultdict(set)
    for h, w in zip(got.hashes.tolist(), [w for t in texts for w in words_of(t)], strict=True):
        by[w].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_choose_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.999, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.999


@pytest.mark.parametrize("block", [2, 512])
def test_ngram_join(spark, block):
    rng = random.Random(2)
    rows, base = [], [sentence(rng, 120) for _ in range(12)]
    for k, t in enumerate(base):
        rows += [(100 * k + j, changed(rng, t, j % 4)) for j in range(rng.randrange(1, 9))]
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "One, two!"), (9004, rows[0][1]), (9004, rows[0][1]), (None, rows[0][1]), (9005, "...")]
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in linked[i])]) for i in range(len(rows))]
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[label[i]].append(rows[i][0])
    want = Counter((rows[i][0], min((x for x in groups[label[i]] if x is not None), default=None), len(linked[i])) for i in range(len(rows)))
    got = Counter(tuple(r) for r in ngram_join.link_classes(docs(spark, rows), block=block).select("doc_id", "class_id", "n_links").collect())
    assert got == want
    assert ngram_join.link_classes(docs(spark, [])).count() == 0


def test_ngram_join_of_very_long_texts(spark):
    """Texts of 60 000 words, one of half another's, and one word of a million letters: links by their whole sets of n-grams."""
    rng = random.Random(12)
    base, other, word = sentence(rng, 60_000), sentence(rng, 60_000), "x" * 1_000_000
    texts = [base, changed(rng, base, 400), changed(rng, base, 900), other, " ".join(base.split()[:30_000] + other.split()[30_000:]), word, word + "y", word, None, ""]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for w in ((t or "").split() for t in texts)]
    linked = [[j for j in range(len(texts)) if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(texts))]
    assert [len(x) for x in linked] == [2, 2, 2, 0, 0, 1, 0, 1, 0, 0]
    got = sorted(tuple(r) for r in ngram_join.link_classes(docs(spark, list(enumerate(texts)))).select("doc_id", "class_id", "n_links").collect())
    assert got == [(i, min([i, *x]), len(x)) for i, x in enumerate(linked)]


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, was = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(was[j - 1] + (x != y), was[j] + 1, d[-1] + 1))
    return d[-1]


def test_edit_distances():
    rng = np.random.default_rng(0)
    a, b, n = rng.integers(0, 4, (200, 12)), rng.integers(0, 4, (200, 12)), rng.integers(0, 13, 200)
    got = decontamination.edit_distances(a, b, n)
    assert got.tolist() == [edit_distance(x[:k].tolist(), y[:k].tolist()) for x, y, k in zip(a, b, n, strict=True)]


def test_leaks(spark):
    rng = random.Random(7)
    items = [(k, sentence(rng, n)) for k, n in enumerate([3, 5, 9, 16, 30, 55, 40])] + [(50, None), (51, ""), (52, "solo")]
    rows = []
    for k in range(90):
        item = items[k % 7][1]
        n = len(item.split())
        text = changed(rng, item, rng.randrange(0, int(0.3 * n) + 1)).split()
        if k % 3 == 0 and n > 5:
            del text[rng.randrange(n)]
        rows.append((k, " ".join([sentence(rng, rng.randrange(0, 60)), *text, sentence(rng, rng.randrange(0, 60))])))
    rows += [(200, None), (201, ""), (202, "solo"), (203, items[3][1]), (203, items[3][1]), (None, items[4][1].upper()), (204, sentence(rng, 4000) + " " + items[5][1])]
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        for item, x in items:
            y = words_of(x)
            k, n, best = decontamination.allowed(len(y)), len(y), None
            for s in range(max(1, len(w) - n + 1)) if y and w else ():
                window = w[s : s + n]
                d = edit_distance(window + [f"?{p}" for p in range(n - len(window))], y)
                if d <= k and (best is None or d < best[0]):
                    best = (d, s)
            if best:
                want[(i, item, best[1], n, best[0])] += 1
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, edits long")
    for block_words in (200_000, 20):
        got = Counter(tuple(r) for r in decontamination.leaks(docs(spark, rows), bench, block_words=block_words).collect())
        assert {k[:2] for k in got} == {k[:2] for k in want}
        assert sum((got & want).values()) >= 0.98 * sum(want.values())  # another window as close may be found first
    kept = decontamination.drop_contaminated(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {k[0] for k in want}
    assert decontamination.leaks(docs(spark, []), bench).count() == 0 and decontamination.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_embedding_recall():
    """Windows at the largest distance allowed share a key with their item at the target rate."""
    rng = random.Random(11)
    items = [sentence(rng, rng.randrange(15, 56)) for _ in range(400)]
    found = decontamination.Items(list(range(400)), items)
    edited = []
    for t in items:
        ws = t.split()
        for p in rng.sample(range(len(ws)), decontamination.allowed(len(ws))):
            ws[p] = f"z{rng.randrange(10**6)}"
        edited.append(" ".join(ws))
    other = decontamination.Items(list(range(400)), edited)
    w, i = found.candidates(other.words, other.sizes)
    missed = 400 - len(set(w[w == i].tolist()))
    assert missed <= 400 * (1 - decontamination.RECALL) + 2 * (400 * (1 - decontamination.RECALL)) ** 0.5


@pytest.mark.parametrize("n", [40, 120, 300, 700])
def test_embedding_recall_with_insertions_and_deletions(n):
    """The target recall at the largest distance, of items of any length: at most as many misses as two standard errors allow."""
    rng, many = random.Random(n), 1500
    items = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for _ in range(many)]
    found = decontamination.Items(list(range(many)), [" ".join(x) for x in items])
    edited = []
    for x in items:
        ws, k = list(x), decontamination.allowed(n)
        moved = rng.randrange(k // 2 + 1)  # a word out and another in are two edits
        for p in rng.sample(range(n), k - 2 * moved):
            ws[p] = f"z{rng.randrange(10**6)}"
        for _ in range(moved):
            del ws[rng.randrange(len(ws))]
            ws.insert(rng.randrange(n), f"z{rng.randrange(10**6)}")
        edited.append(" ".join(ws))
    other = decontamination.Items(list(range(many)), edited)
    w, i = found.candidates(other.words, other.sizes)
    missed = many - len(set(w[w == i].tolist()))
    print(n, missed)
    assert missed <= many * (1 - decontamination.RECALL) + 2 * (many * (1 - decontamination.RECALL)) ** 0.5


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_passages(spark, parts):
    rng = random.Random(4)
    passages = [sentence(rng, n) for n in (49, 50, 51, 70, 130)]
    rows = [(k, " ".join([sentence(rng, rng.randrange(0, 80)), passages[k % 5], sentence(rng, rng.randrange(0, 80))])) for k in range(30)]
    rows += [(100, sentence(rng, 300)), (101, None), (102, ""), (103, passages[3] + " " + passages[3]), (104, passages[4]), (104, passages[4]), (None, passages[1] + " x"), (105, "same " * 200)]
    n, occ, of = 50, Counter(), []
    for _, t in rows:
        w = split_words(pa.array([t], pa.string()))
        of.append(fold(w.hashes, n))
        occ.update(of[-1].tolist())
    want = Counter()
    for (i, _), h in zip(rows, of, strict=True):
        m = np.zeros(len(h) + n if len(h) else 0, bool)
        for p, v in enumerate(h.tolist()):
            if occ[v] > 1:
                m[p : p + n] = True
        step = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        want.update((i, int(a), int(b), int(b - a)) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = Counter(tuple(r) for r in passage_dedup.repeated_passages(docs(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    assert passage_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_passages_of_very_long_texts(spark):
    """A passage deep inside texts of 60 000 words, one at a text's very end, and one word of a million letters, twice."""
    rng = random.Random(13)
    texts = [sentence(rng, n, 10**9).split() for n in (60_000, 60_000, 200)]
    deep, last = (sentence(rng, n, 10**9).split() for n in (60, 50))
    texts[0][50_000:50_060], texts[1][10:70], texts[2][-50:], texts[1][-50:] = deep, deep, last, last
    rows = [*enumerate(map(" ".join, texts)), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (5, None)]
    got = sorted(tuple(r) for r in passage_dedup.repeated_passages(docs(spark, rows)).collect())
    assert got == [(0, 50_000, 50_060, 60), (1, 10, 70, 60), (1, 59_950, 60_000, 50), (2, 150, 200, 50)]


@pytest.mark.parametrize(("parts", "block"), [(1, 1 << 14), (1, 100), (6, 1 << 14)])
def test_passages_around_a_frequent_line(spark, parts, block):
    """Copies '35 own words + a line' whose neighbours in suffix order are other texts with that line."""
    rng = random.Random(9)
    line = sentence(rng, 20)
    rows = [(k, " ".join([sentence(rng, 45), line, sentence(rng, 40)])) for k in range(600)]
    for k in range(40):
        own = sentence(rng, 35)
        rows += [(1000 + 2 * k + j, " ".join([sentence(rng, 12), own, line, sentence(rng, 30)])) for j in (0, 1)]
    want = {(1000 + k, 12, 67, 55) for k in range(80)}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {tuple(r) for r in passage_dedup.repeated_passages(docs(spark, rows), block=block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
