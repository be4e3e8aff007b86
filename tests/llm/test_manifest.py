"""Hard negatives, license scans and Merkle manifests against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.llm import hard_negatives, licenses, merkle

VECTORS = "vec_id long, label int, embedding array<float>, q string, id string, slot int"


def hash_of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- Merkle manifest -----------------------------------------------------------------------------------------------------


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes, fanout):
    tiers = [nodes]
    while len(tiers[-1]) > 1:
        tiers.append([hash_of(*tiers[-1][i : i + fanout]) for i in range(0, len(tiers[-1]), fanout)])
    return tiers


def path(tiers, i, fanout):
    out = []
    for tier in tiers[:-1]:
        run = range(i - i % fanout, min(i - i % fanout + fanout, len(tier)))
        out.append((run.index(i), [tier[j] for j in run if j != i]))
        i //= fanout
    return out


def manifest_by_hand(rows, fanout):
    """``rows``: doc_id, text, lang, source, n_chars."""
    digest = lambda r, text: hash_of(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, digest(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in sources}
    top = tree([trees[s][-1][0] for s in sources], fanout)
    for g, s in enumerate(sources):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            proof = path(trees[s], i, fanout) + path(top, g, fanout)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = digest(r, r[1].replace("\n", "") if bad and r[1] is not None else r[1])
            for place, others in proof:
                now = hash_of(*others[:place], now, *others[place:])
            yield r[0], leaf, trees[s][-1][0], top[-1][0], hash_of(*[x for _, others in proof for x in others]), now, now == top[-1][0]


@pytest.mark.parametrize(("fanout", "levels", "sources"), [(3, 1, 1), (3, 2, 5), (2, 3, 40), (3, 7, 2)])
def test_manifest(spark, tmp_path, fanout, levels, sources, monkeypatch):
    rng = random.Random(levels)
    rows = [(k * 7 % 331, rng.choice(["a\nb", "é\n", "", None, "x" * 50_000]) if k % 9 else f"t{k}\n", rng.choice(["en", None]), rng.choice([f"s{k % sources}", "s0", None, "é"]) if sources > 1 else "s0", k) for k in range(300)]
    rows += [(5, "same", "en", "s0", 4)] * 3 + [(None, "no id\n", None, "lone", None), (None, "no id", None, "s0", 1), (2**60 + 1, "big\n", None, "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("g", "idx", "n", "digest", "id", "now")}).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", (merkle.FIELDS, "source", "doc_id", fanout, levels, None))
    got = [tuple(r) for r in merkle.query(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(manifest_by_hand(rows, fanout)) and {r[-1] for r in got} == {True, False}


def test_manifest_odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    row = (1, "t", "en", "s", 1)
    (only,) = merkle.verify(merkle.manifest(spark.createDataFrame([row], schema))).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.verified and only.lefts == [] == only.rights


# --- license scans ---------------------------------------------------------------------------------------------------------


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for k, _, _, pattern, label, kind in licenses.rules():
        wanted = re.compile(f"(?:{pattern})(?= |$)")
        for at in range(len(words)):
            m = wanted.match(" ".join(words[at : at + licenses.REACH]))
            if m:
                found.append((kind, at, at + len(m[0].split(" ")), k, label))
    before = lambda a, b: (a[0], a[1] - a[2], a[3]) < (b[0], b[1] - b[2], b[3])
    kept = [d for d in found if d[0] == 0 or not any(o[1] <= d[1] and o[2] >= d[2] and before(o, d) for o in found)]
    base = [d for d in found if d[0] == 0]
    starts = [d[1] for d in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in kept})),
        max((licenses.SCORES[d[0]] for d in kept), default=0.0),
    )


LICENSED = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-2.0-or-later\nunder the MIT\tlicense under the mit license", "under the mit", "license", "mit", "aunder the MIT license", "under the MIT licensee",
    "CC BY-NC-SA 3.0 cc by nc", "cc by nc", "Permission is hereby granted, free of charge, to any person obtaining a copy", "GPLv3 gplv2 or GPL v2 or later", "licensed under a custom license",
    "You just do what the fuck you want to. Do what the fuck you want to public license", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "the origin of this software must not be misrepresented; altered source versions must be plainly marked as such", "names of its contributors may be used to endorse or promote products", "All rights reserved.",
    "https://creativecommons.org/licenses/by-sa/4.0/ https://www.apache.org/licenses/LICENSE-2.0", "buy me a beer: you can buy me a beer in return", "Kİ mit lİcense é under the mit license",
]
ODD_TEXTS = [None, "", " \n.,", "a", "é", "no terms here", "MIT License " * 3000, "x " * 30000 + "under the MIT license", "license-" * 5000]


def test_license_scan(spark):
    rng = random.Random(1)
    parts = [w for t in LICENSED for w in t.split(" ")]
    texts = LICENSED + ODD_TEXTS[:6] + [" ".join(rng.choice([rng.choice(LICENSED), " ".join(rng.choices(parts, k=5)), "some other words"]) for _ in range(6)) for _ in range(60)]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)] + [(1, LICENSED[0])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("uid", "places", "label", "at", "rule", "kind", "said", "words")})
    got = Counter(tuple(r) for r in licenses.summarised(*licenses.scan(docs)).collect())
    assert got == Counter((i, *scan_by_hand(t)) for i, t in rows)
    assert {r[5] for r in got} >= {"mit", "apache-2"}


def test_license_long_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.summarised(*licenses.scan(docs)).collect()}
    assert got[6].n_words == 6000 and got[6].labels == "mit" and got[6].n_base == 0
    assert (got[7].n_base, got[7].first_word, got[7].base_labels) == (1, 30000, "mit") and got[8].n_words == 5000 and got[8].labels == ""
    assert licenses.summarised(*licenses.scan(docs.limit(0))).collect() == []


def test_license_rules():
    """Hundreds of rules, each with its keyword where its table says, within reach; one example of each place."""
    table = licenses.rules()
    assert len(table) > 300 and len({r[0] for r in table}) == len(table)
    for _, word, lead, pattern, _, _ in table:
        assert lead <= licenses.LEAD and "'" not in pattern
        words = re.sub(r"\(([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(([^()|]*)[^()]*\)\??", r"\1", pattern)).replace("[cs]", "s" if "licens" in word else "c" if "licenc" in word else "s").split()
        assert len(words) <= licenses.REACH
        assert re.sub(r"[^a-z0-9]", "", words[lead]).startswith(re.sub(r"[^a-z0-9]", "", word)[:3]), (word, lead, pattern)


# --- hard negatives --------------------------------------------------------------------------------------------------------


def mined_by_hand(rows, k=5):
    valid = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        valid.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in valid:
        if a[0] % 100:
            continue
        others = sorted(((-score(a[2], r[2]), r[0], r[1]) for r in valid if r[0] != a[0]), key=lambda r: r[:2])
        for ps, p, _ in [r for r in others if r[2] == a[1]][:k]:
            window = [r for r in others if r[2] != a[1] and 80 * -ps <= 100 * -r[0] <= 100 * -ps]
            yield from ((a[0], p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(window[:k], 1))


def vectors(seed, n=260, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = [(int(k), int(rng.integers(0, 4)), [float(v) for v in np.float32(centres[rng.integers(0, 4)] + rng.normal(size=width) * 0.6)]) for k in rng.permutation(n) * 5]
    return rows + [(300, 1, None), (400, None, rows[0][2]), (None, 1, rows[0][2]), (500, 2, [float("nan")] * width), (600, 2, [*rows[0][2][:-1], None]), (700, 3, [*rows[0][2][:-1], float("inf")])]


@pytest.mark.parametrize("kind", ["plain", "ties", "same", "repeats", "short"])
def test_hard_negatives(spark, tmp_path, kind, monkeypatch):
    rows = vectors(3)
    if kind == "ties":
        rows = [(i, label, x and [math.copysign(0.5, v) if v and math.isfinite(v) else v for v in x[:3]]) for i, label, x in rows]
    if kind == "same":
        rows = [(i, label, rows[0][2]) for i, label, _ in rows]
    if kind == "repeats":
        rows += rows[:60]
    if kind == "short":
        rows = [(i, label, x and x[: k % 13]) for k, (i, label, x) in enumerate(rows)]
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id long, label int, embedding array<float>, q string, id string, slot int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(hard_negatives, "PAIRS", 64)
    monkeypatch.setattr(hard_negatives.mine, "__defaults__", (5, 5, 80, 100, 3 if kind == "plain" else 4096))
    want = Counter(mined_by_hand(rows))
    got = Counter(tuple(r) for r in hard_negatives.query(spark, str(tmp_path)).collect())
    if kind == "repeats":  # ranks go over all rows of a positive's id
        strip = lambda c: Counter((r[0], r[1], *r[3:]) for r in c.elements())
        assert set(strip(got)) == set(strip(want))
    else:
        assert got == want and got
    spark.catalog.clearCache()


def test_hard_negatives_odd(spark):
    schema = "vec_id long, label int, q array<long>"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, 1, []), (1, 1, []), (2, 2, [])], schema), F.col("vec_id") % 100 == 0).collect() == [(100, 1, 1, 2, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(100, 1, [1 << 40]), (1, 1, [1 << 40])], schema), F.col("vec_id") % 100 == 0).collect()


def test_rotation_discards():
    """Most pairs are discarded before they are verified, and none that counts."""
    rng = np.random.default_rng(0)
    basis = rng.normal(size=(3, 32))
    q = np.floor(256 * (rng.normal(size=(4000, 3)) @ basis + 0.05 * rng.normal(size=(4000, 32)))).astype(np.int64)
    turn = np.linalg.eigh((q.T @ q).astype(float))[1][:, ::-1]
    steps, seen = hard_negatives.steps_of(32), []
    best = hard_negatives.Best(10, 5)

    def found(a, b, score):
        seen.append(len(a))
        best.add(a, score, b)

    a, r = hard_negatives.Turned(q[:10], turn, steps), hard_negatives.Turned(q, turn, steps)
    hard_negatives.settle(a, r, steps, hard_negatives.slack_of(32), np.ones((10, 4000), bool), lambda: best.floor.astype(float), np.full(10, np.inf), found)
    scores = q[:10] @ q.T
    want = {(k, int(j)) for k in range(10) for j in sorted(range(4000), key=lambda j: (-scores[k, j], j))[:5]}  
    assert set(zip(best.slot.tolist(), best.id.tolist(), strict=True)) == want and sum(seen) < 1000
