"""Periodic runs against brute force; the quality classifier's network against
numerical gradients, its held-out accuracy, and edge rows of both."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from strata.llm import periodic, quality, queries
from strata.llm.common import table

# --- op12


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q) and not any(w[s:s + length - r] == w[s + r:s + length] for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out)


def brute_report(doc_id, text, rewrite):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    if rewrite and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def repetitive(rng, n, k):
    w = []
    while len(w) < n:
        if rng.random() < 0.4:
            w += [str(rng.randrange(k)) for _ in range(rng.randrange(1, 12))]
        else:
            unit = [str(rng.randrange(k)) for _ in range(rng.randrange(1, rng.choice([3, 8, 30])))]
            w += (unit * rng.randrange(2, 12))[:rng.randrange(1, 200)]
    return w[:n]


EDGE = [(1, None), (2, ""), (3, " \t\r\n"), (4, "a"), (5, "a a a a a"), (6, "a a a a a a"), (6, "a a a a a a"), (None, "b a b a b a b a"), (7, "x" * 50_000),
        (8, "w " * 5000), (9, "a b " * 40), (10, "p q r " * 700 + "s " + "t u " * 900), (30, "one two three four five six seven eight nine ten")]


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    for p in periodic.PRIMES:
        for n in (2, 4, 64, 128, 4096):
            t = periodic.transform(p, n)
            a, b = rng.integers(-(p // 2), p // 2, (2, n, 2))
            c = t.inverse(t.reduce(t.forward(a.astype(float)) * t.forward(b.astype(float))))
            for at in (0, 5 % n, n - 1):
                assert int(c[at, 0]) % p == sum(int(a[i, 0]) * int(b[(at - i) % n, 0]) for i in range(n)) % p


@pytest.mark.parametrize("block", [2048, 8, 1])
def test_runs_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(25):
        texts = [repetitive(rng, rng.randrange(0, 220), rng.choice([1, 2, 3, 50])) for _ in range(10)]
        got = periodic.Words([[w.encode() for w in t] for t in texts]).runs()
        assert got == [brute_runs(t) for t in texts]


def test_more_primes_where_sums_are_large():
    base = [str(i) for i in range(9000)]  # 9000 distinct words: sums beyond one prime
    w = base + base[:700] * 5
    assert periodic.Words([[x.encode() for x in w]]).runs() == [[(len(base) - 0, 3500, 700)]]


def test_report_of_the_table_and_edges(spark):
    got = sorted(map(tuple, queries.op12(spark, SF001).collect()))
    rows = table(spark, SF001, "documents").select("doc_id", "text").collect()
    assert got == sorted(brute_report(r.doc_id, r.text, True) for r in rows)
    assert sum(r[1] > 0 for r in got) >= len(got) // 20
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"start": F.lit(1), "runs": F.lit("x")}).repartition(2)
    order = lambda rows: sorted(rows, key=str)
    for rewrite in (None, periodic.planted):
        assert order(map(tuple, periodic.report(df, rewrite).collect())) == order(brute_report(i, t, rewrite) for i, t in EDGE)
    assert periodic.report(df.limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("period", F.lit(0))
    assert sorted(map(tuple, periodic.find_runs(df.where("doc_id = 10")).collect())) == [(10, 0, 2100, 3), (10, 2101, 1800, 2)]
    texts = {r.doc_id: r.text for r in periodic.collapse(df).collect()}
    assert texts[10] == "p q r s t u" and texts[1] is None and texts[3] == " \t\r\n" and texts[6] == "a" and texts[8] == "w" and len(texts[7]) == 50_000


# --- op13


def test_gradients_against_differences():
    w = {k: a.astype(np.float64) for k, a in quality.initial(3).items()}
    x = quality.padded("some words, then MORE!! words! " * 20)

    def loss(v):
        units = quality.chunk_units(quality.hops(x, v)[0], v)[1].max(0)
        p = 1 / (1 + np.exp(-(units @ v["out"] + v["bias"][0])))
        return -2.0 * np.log(1 - p)

    grad = {k: np.zeros_like(a) for k, a in w.items()}
    quality._backward(x, 0.0, 2.0, w, grad)
    rng = np.random.default_rng(0)
    for k, a in w.items():
        step = rng.normal(size=a.shape)
        lo, hi = (loss({**w, k: a + s * 1e-6 * step}) for s in (-1, 1))
        assert np.isclose((hi - lo) / 2e-6, (grad[k] * step).sum(), rtol=2e-3, atol=1e-6), k


def test_chunks_cover_the_whole_text():
    w = quality.initial(0)
    w["filters"][:] = 0
    w["embed"][:] = 0
    w["embed"][ord("#"), 0] = 1
    w["filters"][::quality.EMBED, 0] = 1
    for n in (0, 1, 127, 128, 129, 255, 256, 4000, 33_000, 70_001):
        for at in sorted({0, n // 2, n - 1}) if n else []:
            text = "a" * at + "#" + "a" * (n - at - 1)
            assert quality.hops(quality.padded(text), w)[0][:, 0].max() > 0, (n, at)
        assert quality.hops(quality.padded("a" * n), w)[0][:, 0].max(initial=0) == 0


def test_held_out_accuracy_and_labels(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = {r.doc_id: r for r in queries.op13(spark, SF01).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.quality, got[r.doc_id].score) for r in labels.collect() if r.quality is not None and r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == q for q, s in held]) > 0.93


def test_classifier_edges(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 30)
    rows = [(k, "plain words of a text " * 20 if k % 2 else "JUNK!! JUNK!! " * 30, "x", 5) for k in range(40)]
    rows += [(None, "no id", "x", 5), (90, None, "x", 5), (91, "", "x", 5), (92, "a" * 40_000, "x", 5), (90, None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int").repartition(3)
    marks = [(k, k % 2, 9) for k in range(40)] + [(None, 1, 9), (91, None, 9), (3, 0, 9), (777, 1, 9), (5, 1, 9)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text int")
    assert {r.doc_id: r.label for r in quality.labelled(labels).collect()} == {**{k: k % 2 for k in range(40)}, 3: 0, 777: 1}
    got = quality.report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    alike = {r.doc_id: r.score for r in got}
    assert alike[90] == alike[91] and alike[1] > alike[2]
    assert quality.report(docs.limit(0), labels).count() == 0
    for some, score in ((labels.limit(0), 0.5), (labels.where("quality = 1 and doc_id < 4"), 1.0)):
        assert {r.score for r in quality.report(docs, some).collect()} == {score}
