"""The quality classifier: features and updates against plain Python, held-out figures, awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality, queries
from tidemark.llm.common import hash_words

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+")
M = 2**64


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def plain_features(text):
    tokens = TOKEN.findall(text)
    h = [int(hash_words(np.frombuffer(t.lower(), np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
    shapes, last = [], None
    for t, x in zip(tokens, h, strict=True):
        if re.match(rb"[A-Za-z\x80-\xff]", t):
            n = len(re.findall(rb"[A-Z]", t))
            shapes.append((1 if not n else 3 if n == len(t) and n > 1 else 2) + 8 * (x == last))
            last = x
        else:
            shapes.append(4 if t[:1].isdigit() else x | 1 << 63)
    out = Counter()
    for values, longest, seed in ((h, 2, 1), (shapes, 3, 101)):
        for n in range(1, longest + 1):
            for k in range(len(values) - n + 1):
                x = seed
                for v in values[k : k + n]:
                    x = mixed(x * 0x9E3779B97F4A7C15 % M ^ v)
                out[x >> 64 - quality.BITS] += 1
    return out, len(tokens)


TEXTS = [b"", b"  \n", b"One two two, TWO!! 12 x%%% \xc3\xa9t\xc3\xa9 \xc3\xa9t\xc3\xa9", b"A a A. a", b"&&& | a | b", "日本 語 Ab1c2".encode()]


@pytest.mark.parametrize("text", TEXTS)
def test_features(text):
    want, words = plain_features(text)
    bucket, value = quality._features(text)
    assert bucket.tolist() == sorted(want)
    assert np.allclose(value, [quality.SCALE * want[b] / max(words, 1) for b in bucket.tolist()])


def test_scores_are_sparse_dot_products(monkeypatch):
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=1 << quality.BITS), 0.25)
    long = b" ".join(rng.choice([b"alpha", b"BETA", b"x9", b"--", b"Gamma"], 5000).tolist()) + b"z" * 3000
    texts = [*TEXTS, long]
    for size in (1 << 17, 500):
        monkeypatch.setattr(quality._pieces, "__defaults__", (size,))
        got = model.scores(texts)
        for text, score in zip(texts, got, strict=True):
            bucket, value = quality._features(text)
            assert math.isclose(score, 1 / (1 + math.exp(-(0.25 + model.weights[bucket] @ value))), rel_tol=1e-6)
    for text, score in zip(TEXTS, got, strict=False):
        want, words = plain_features(text)
        z = 0.25 + quality.SCALE * sum(n * model.weights[b] for b, n in want.items()) / max(words, 1)
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_updates():
    """Against the algorithm in dictionaries, one coordinate at a time."""
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(40, 6, replace=False)).astype(np.int32), rng.random(6).astype(np.float32), int(rng.integers(2)), float(rng.choice([1.0, 2.5]))) for _ in range(30)]
    z, n, bias = Counter(), Counter(), 1 << quality.BITS

    def weight(i):
        l1 = 0 if i == bias else quality.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)).tolist():
            b, v, label, importance = rows[k]
            x = dict(zip(b.tolist(), v.tolist(), strict=True)) | {bias: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * xi for i, xi in x.items())))
            for i, xi in x.items():
                g, w = importance * (p - label) * xi, weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w
                n[i] += g * g
    model = quality.train(rows)
    assert np.allclose(model.weights[:40], [weight(i) for i in range(40)], atol=1e-6)
    assert math.isclose(model.bias, weight(bias), abs_tol=1e-6)
    assert not model.weights[40:].any()


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels, strict=True) if y]
    neg = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.quality_scores(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in rows.items())
    labels = [(rows[x.doc_id].score, x.quality) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert auc(*zip(*labels, strict=True)) > 0.97
    assert sum((s >= 0.5) == y for s, y in labels) / len(labels) > 0.93


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 0.1), (1, "good words here", 0.1), (2, None, None), (None, "BAD!! BAD!!", 1.0), (3, "", 2.0), (4, "BAD!! WORDS!!", 0.0), (5, "x" * 300_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (2, 1), (None, 0), (3, None), (9, 1), (5, 7)], "doc_id long, quality int")
    rows = quality.sample(docs, labels)
    assert [(r[2], len(r[0]) > 0) for r in rows] == [(1, True), (1, True), (1, False), (0, True)]
    got = quality.scored(docs, quality.train(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "5", "None"]
    bias = {round(r.score, 12) for r in got if r.doc_id in (2, 3)}
    assert len(bias) == 1
    none = quality.fit(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in quality.scored(docs, none).collect()} == {(0.5, 1)}
    assert quality.scored(docs.limit(0), none).collect() == []


def test_a_class_with_more_rows_weighs_more(spark):
    docs = spark.createDataFrame([(k, f"w{k}") for k in range(30)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 = 0) as quality")
    rows = quality.sample(docs, labels, per_class=9)
    assert len(rows) == 12 and sum(r[3] for r in rows if r[2]) / sum(r[3] for r in rows) == pytest.approx(0.1)
