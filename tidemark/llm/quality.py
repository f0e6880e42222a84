"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's words are its runs of letters, of digits, and of other marks, A to Z in lower case. Its features are the n-grams of
words up to two, and those of word shapes up to three: lower case, capitalised, upper case, number, or the mark itself, each
with a note if the same word came before. A feature's value is its share of the text's words, so a score is a sparse dot
product of counts and weights, and a long text is scored piece by piece: texts are cut at the first white space after
every `PIECE` bytes, and no n-gram reaches over a cut.

The classifier is fitted on the driver, one update a row, on at most `PER_CLASS` labelled rows of each class, those of the
least hashes; rows of a class that has more weigh as many times as much. Features are made in the tasks, from whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_words, keyed, mixed, real_id, slices, texts_of

PER_CLASS, BITS, WORDS, SHAPES, PIECE = 4000, 18, 2, 3, 1 << 17
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.3, 1.0, 0.02, 0.001, 16.0
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Of each byte its kind: 0 white space, 1 lower case or part of another letter, 2 upper case, 3 digit, 4 mark.
_KINDS = np.full(256, 4, np.uint8)
_KINDS[[32, *range(9, 14)]] = 0
_KINDS[[*range(97, 123), *range(128, 256)]] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_GRAM = np.uint64(0x9E3779B97F4A7C15)


def _pieces(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Pieces of the texts, joined to about `size` bytes: the bytes, each piece's end, and the text that it is of."""
    held, owner, total = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            found = _SPACE.search(text, at + size, at + 2 * size) if len(text) - at > size else None
            to = found.start() if found else min(len(text), at + (2 * size if len(text) - at > size else size))
            held.append(text[at:to] + b" ")
            owner.append(k)
            total += to - at
            at = to
            if total >= size:
                yield b"".join(held), np.cumsum([len(h) for h in held]), np.array(owner)
                held, owner, total = [], [], 0
    if held:
        yield b"".join(held), np.cumsum([len(h) for h in held]), np.array(owner)


def grams(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of pieces, the piece of each, and each piece's number of words."""
    codes = np.frombuffer(data, np.uint8)
    kinds = _KINDS[codes]
    kind = np.where(kinds == 2, 1, kinds)
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))  # the last byte is white space
    starts, stops = edge[:-1], edge[1:]
    words = kind[starts] > 0
    starts, stops = starts[words], stops[words]
    lower = np.where(kinds == 2, codes + 32, codes)
    h = hash_words(lower, starts, stops)
    piece = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(piece, minlength=len(ends))
    upper = np.concatenate([[0], np.cumsum(kinds == 2)])
    n_upper, first = upper[stops] - upper[starts], kinds[starts]
    shape = np.where(n_upper == 0, 1, np.where((n_upper == stops - starts) & (n_upper > 1), 3, 2)).astype(np.uint64)
    letters = np.flatnonzero(kind[starts] == 1)
    again = np.zeros(len(h), np.uint64)  # the word before is the same, marks between them aside
    again[letters[1:]] = (h[letters[1:]] == h[letters[:-1]]) & (piece[letters[1:]] == piece[letters[:-1]])
    shape = np.where(first == 3, np.uint64(4), np.where(first == 4, h | np.uint64(1 << 63), shape + np.uint64(8) * again))
    buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for values, longest, seed in ((h, WORDS, 1), (shape, SHAPES, 101)):
        x = np.full(len(values), seed, np.uint64)
        for n in range(1, longest + 1):
            if len(values) < n:
                break
            x = mixed((x[: len(values) - n + 1] * _GRAM) ^ values[n - 1 :])
            own = piece[n - 1 :] == piece[: len(x)]
            buckets.append((x[own] >> np.uint64(64 - BITS)).astype(np.int32))
            owners.append(piece[: len(x)][own])
    return np.concatenate(buckets), np.concatenate(owners), counts


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their values."""
    found, words = [], 0
    for data, ends, _ in _pieces([text]):
        bucket, _, counts = grams(data, ends)
        found.append(bucket)
        words += int(counts.sum())
    bucket, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
    return bucket, (SCALE / max(words, 1) * n).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for data, ends, owner in _pieces(texts):
            bucket, piece, counts = grams(data, ends)
            np.add.at(total, owner, np.bincount(piece, weights=self.weights[bucket], minlength=len(ends)))
            np.add.at(words, owner, counts)
        z = self.bias + SCALE * total / words.clip(1)
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, float]], seed: int = 7) -> Model:
    """Follow-the-regularised-leader updates over (buckets, values, label, weight), in a seeded order each time."""
    size = (1 << BITS) + 1  # the last is the bias, which has no penalty
    z, n, l1 = np.zeros(size), np.zeros(size), np.full(size, L1)
    l1[-1] = 0
    rng = np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        free = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0)
        return -free / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            bucket, value, label, weight = rows[k]
            at, x = np.append(bucket, size - 1), np.append(value, 1.0)
            w = weights(at)
            g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -500, 500))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return Model(w[:-1], float(w[-1]))


def sample(docs: DataFrame, labels: DataFrame, where: Column | bool = True, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[np.ndarray, np.ndarray, int, float]]:
    """Features, label and weight of at most per_class labelled rows of each class, those of the least hashes of their ids.

    Labels are 1 or 0; a label of anything else, or without an id, is none. A document that is labelled twice is learned
    twice. Of documents that share an id one is learned from.
    """
    given = labels.where(F.lit(where) if isinstance(where, bool) else where).select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("long").alias("label"))
    given = given.where("id is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    total = sum(counts.values())
    taken = None
    for label, n in sorted(counts.items()):
        least = given.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        taken = least if taken is None else taken.unionByName(least)
    kept = sum(min(n, per_class) for n in counts.values())
    weight = {label: n / min(n, per_class) * kept / total for label, n in counts.items()}
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    # two classes of per_class rows at most are broadcast
    rows = texts.join(F.broadcast(taken.groupBy("id", "label").agg(F.count(F.lit(1)).alias("times"))), "id")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [_features(t) for t in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("id", "label", "times", "tag")), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["id", "label", "times", "tag", "buckets", "values"],
            )

    found = rows.withColumn("tag", F.xxhash64("text")).mapInArrow(made, "id long, label long, times long, tag long, buckets binary, values binary")
    one = found.groupBy("id", "label", "times").agg(F.min_by(F.struct("buckets", "values"), "tag").alias("f")).select("id", "label", "times", "f.buckets", "f.values")
    out = sorted(one.collect(), key=lambda r: (r["id"], r["label"]))
    return [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["values"], np.float32), r["label"], weight[r["label"]]) for r in out for _ in range(r["times"])]


def fit(docs: DataFrame, labels: DataFrame, where: Column | bool = True, **columns) -> Model:
    """where: which rows of labels may be learned from. Without any, every score is a half."""
    return train(sample(docs, labels, where, **columns))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 if the score is a half or more) of each row's whole text.

    A null text is an empty one, whose score is the bias alone, as is that of white space. Rows with null or repeated doc_id
    come out as they are. Other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(model.scores(texts_of(part, "_text")))], names=["_id", "score"])

    made = keyed(docs, id_col, text_col).mapInArrow(rows, "_id long, score double")
    return made.select(real_id(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
