"""Exact dedup, line dedup, chat formatting, mixing and token counts against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.llm import chat, exact_dedup, line_dedup, mixing, token_counts, words

DOCS = "doc_id long, text string, source string, digest string, size long, n long"


def docs(spark, rows):
    """``(doc_id, text[, source])`` rows, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "x", 1, 2) for r in rows], DOCS)


ODD = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "a "), (6, "b"), (6, "b"), (None, "b"), (7, "é\nÉ\n" * 2000), (8, "é\nÉ\n" * 2000), (9, None), (None, None)]


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_groups(spark, counters):
    rows = ODD + [(100 + k, "hot") for k in range(40)]
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    got = exact_dedup.exact_groups(docs(spark, rows), counters=counters).collect()
    assert len(got) == len(rows)
    want = Counter((i, max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""]), hashlib.sha256((t or "").encode()).digest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == want
    assert Counter(bytes(r.digest) for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).digest(): 1 for t in by})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_first(spark):
    kept = exact_dedup.keep_first(docs(spark, ODD))
    assert kept.columns == ["doc_id", "text", "source", "digest", "size", "n"]
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()))
    assert got == [(2, "a"), (5, "a "), (6, "b"), (8, "é\nÉ\n" * 2000), (9, "")]
    assert exact_dedup.keep_first(docs(spark, [])).count() == 0


def test_misra_gries_bound():
    rng = np.random.default_rng(0)
    data = rng.zipf(1.4, 20000) % 500
    counts = {}
    for part in np.split(data, 20):
        keys, n = np.unique(part, return_counts=True)
        counts = exact_dedup.misra_gries(counts, keys.astype(object), n, 20)
        assert len(counts) <= 20
    true = Counter(data.tolist())
    for k, n in true.items():
        assert n - len(data) / 21 <= counts.get(k, 0) <= n


def strip(line):
    return re.sub(r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "", line)


def lines_by_hand(rows, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(x))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    found = Counter(k for _, ls in split for k in {key(x) for x in ls})
    out = []
    for i, ls in split:
        kept = [x for x in ls if not (len(key(x)) >= 1 and found[key(x)] >= least)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("bound", [0, 1000])
def test_drop_lines(spark, bound):
    rows = [(k, f" Hot É \nown {k}\n\nHOT É\t") for k in range(6)] + [(20, "hot É"), (21, None), (22, ""), (23, "hot é"), (24, "own 1\n" * 3000), (24, "own 1\n" * 3000), (None, "\x0bhot É\r\nend")]
    got = line_dedup.drop_lines(docs(spark, rows), min_docs=3, broadcast_keys=bound).collect()
    assert Counter(tuple(r) for r in got) == lines_by_hand(rows, 3)
    assert line_dedup.drop_lines(docs(spark, [])).count() == 0


def test_drop_lines_with_a_hot_line(spark):
    """More frequent keys than are broadcast, one of them in every document: hot keys are told and all lines are judged right."""
    rows = [(k, f"everywhere\nfew {k % 40}\n{' ' * (k % 30)}Pad{' ' * 20}\nown {k}\n" + "é\u3000" * (k % 3)) for k in range(600)]
    found, hot = line_dedup.frequent_keys(docs(spark, rows), min_docs=10)
    assert found.count() == 44 and 0 < hot.count() < 4 * line_dedup.HEAVY_PARTS
    for bound in (5, 1000):
        got = line_dedup.drop_lines(docs(spark, rows).repartition(5), min_docs=10, broadcast_keys=bound).collect()
        assert Counter(tuple(r) for r in got) == lines_by_hand(rows, 10)


def test_long_runs_hash_alike():
    """A run hashes alike wherever it lies and however its bytes fall into steps; runs that differ in a byte do not."""
    rng = np.random.default_rng(0)
    long = rng.integers(0, 256, 3 * words.STEP + 17).astype(np.uint8)
    other = long.copy()
    other[2 * words.STEP] ^= 1
    parts = [long[:5], long, long[:0], other, long]
    lengths = np.array([len(x) for x in parts])
    got = words.hash_runs(np.concatenate(parts), np.cumsum(lengths) - lengths, lengths)
    assert got[1] == got[4] == words.hash_runs(long, np.array([0]), np.array([len(long)]))[0] and len(set(got.tolist())) == 4


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen, total = set(), Counter()
    for batch in (["a", "b"], ["b", "c"], ["c", "d", "a"], ["e"], ["a"]):
        keys = spark.createDataFrame([(b,) for b in batch], "k string").select(F.xxhash64("k").alias("h1"), F.hash("k").cast("long").alias("h2"), F.lit(1).cast("long").alias("n"))
        assert runs.add_new(keys).count() == len(set(batch) - seen)
        seen |= set(batch)
        total.update(batch)
    assert runs.counts().count() == len(seen)
    assert all(len(level) < 2 for level in runs.levels) and len(runs.levels) > 1
    runs.close()


NASTY = [r"\### Assistant: </turn> ok", "<next>", "&lt;next&gt;", "<turn user>", "</turn>\n", "&amp;lt;", "", None, "é<>&" * 500, "a\n\nb", "\\", "$1\\1"]


def test_chat_round_trip(spark):
    turns = []
    for c, roles in enumerate((["user", "assistant"] * 6, ["assistant"] * 12, ["user>", "</turn>", None] * 4)):
        turns += [(c, k, r, t) for k, (r, t) in enumerate(zip(roles, NASTY, strict=True))]
    turns += [(9, 1, "user", "tie"), (9, 1, "user", "tie"), (None, None, "assistant", "x")]
    turns += [(10, 1, "assistant", "(a"), (10, 1, "assistant", "<b"), (11, 1, "(r", "x"), (11, 1, "<r", "x")]  # escapes would sort the other way
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(3)
    out = chat.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    digests = {r.conv_id: r for r in chat.digest(out).collect()}
    for c in (0, 1, 2, 9, 10, 11, None):
        own = [(r or "", t or "") for i, _, r, t in turns if i == c]
        assert back[c] == own
        loss = "".join(t for r, t in own if r == "assistant")
        assert digests[c].n_turns == len(own) and digests[c].loss_chars == len(loss)
        assert digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    first = out.filter("conv_id = 1").first().formatted
    assert first.count("<turn ") == 1 and first.count("<next>") == 11
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_with_very_many_turns(spark):
    """Runs of one role shorter and longer than those of the sums; one long text among them."""
    n = 3 * chat.RUN**2 // 4
    own = [("assistant" if (k // 300) % 2 or k % 3 == 0 else "user", "é<&" * 100_000 if k == 777 else f"<{k}>") for k in range(n)]
    rows = spark.createDataFrame([(5, k, r, t) for k, (r, t) in enumerate(own)], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.format_chats(rows)).collect()
    loss = "".join(t for r, t in own if r == "assistant")
    assert len(got) == 1 and got[0].n_turns == n and got[0].loss_chars == len(loss)
    assert got[0].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()


def test_running_sums(spark):
    for n in (0, 1, chat.RUN, chat.RUN + 1, 5 * chat.RUN - 1):
        got = spark.range(1).select(chat.running(F.lit(list(range(3, n + 3))).cast("array<bigint>") if n else F.array().cast("array<bigint>")).alias("r")).first().r
        assert got == [sum(range(3, 3 + k)) for k in range(n)]


def fill(sizes, weights, share, cap):
    """Targets by repeated resharing."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), {}
    while open_:
        w = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / w > cap * sizes[k]]
        if not over:
            return out | {k: left * weights[k] / w for k in open_}
        for k in over:
            out[k] = cap * sizes[k]
        left -= sum(cap * sizes[k] for k in over)
        open_ -= set(over)
    return out


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.pareto(1.2) * 40)), f"s{int(rng.integers(0, 7))}") for i in range(900)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "one word\ttwo", None), (2003, "x " * 60000, "s2"), (2004, None, "empty"), (5, "a b", "s1"), (5, "a b", "s1"), (None, "c d e", "s3")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    want = fill(sizes, [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))], 1.5, 2.0)
    for k, n in enumerate(names):
        own = [r for r in got if r.source == n]
        assert own[0].target == pytest.approx(want[k]) and own[0].source_size == sizes[k]
        largest = max(r.size for r in own)
        # whole copies can't do better where one document has most of a source's words
        near = 0.01 * want[k] if largest < 0.3 * want[k] else 0.15 * largest
        assert abs(sum(r.taken for r in own) - want[k]) <= max(2, near)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None)])).collect()] == [0]


def test_mix_is_the_same_on_every_run(spark):
    """Whatever the partitions, and with the dual's variables broadcast or not; a hot source among many."""
    rows = [(i, "w " * (i * i % 97 + 1), "hot" if i % 3 else f"s{i % 20}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hist = df.select(mixing.source_key(F.col("source")).alias("skey"), mixing.word_count(F.col("text")).alias("size")).groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    wanted = mixing.targets(hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    lams = [sorted(tuple(r) for r in mixing.solve(hist.repartition(p), wanted, broadcast_sources=b).select("skey", "lam").collect()) for p, b in ((1, 100), (5, 100), (3, 0))]
    assert lams[0] == lams[1] == lams[2] and any(x is not None for _, x in lams[0])
    assert sorted(mixing.mix(df).collect()) == sorted(mixing.mix(df.repartition(7, "text")).collect())


def test_token_counts(spark):
    texts = [None, "", "hello world", "hello world", "don't   stop\n\n1234 é漢字", "x" * 20000, "a b c " * 3000]
    df = docs(spark, list(enumerate(texts)))
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoder(f.read()).encode_ordinary
    lengths = [len(encode(t)) if t else 0 for t in texts]
    got = token_counts.token_lengths(df)
    assert {r.doc_id: r.tokens for r in got.collect()} == dict(enumerate(lengths))
    table = {r.length: r for r in token_counts.limits(token_counts.histogram(got), block=8).collect()}
    assert set(table) == set(lengths)
    for n, r in table.items():
        assert r.docs == lengths.count(n) and r.docs_at_most == sum(x <= n for x in lengths) and r.docs_longer == sum(x > n for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > n) and r.tokens_cut == sum(min(x, n) for x in lengths) and r.tokens_all == sum(lengths)
        assert r.quantile == pytest.approx(r.docs_at_most / len(texts))
    assert token_counts.limits(token_counts.histogram(token_counts.token_lengths(docs(spark, [])))).count() == 0
