"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy.

The classifier is fitted on the driver on a bounded sample of labelled rows: `PER_LANG` of each language, fewer where
there are so many languages that these would be over `SAMPLE_ROWS` (but one at least). Of a text over `SAMPLE_CHARS`
characters it learns from `WINDOWS` windows spread evenly over the whole text. Prediction runs over every row and whole
text in the tasks. The average of embeddings under a linear layer is the average of each bucket's logits, so a
prediction adds up one small row per subword, and a long text is predicted piece by piece.

Scores are calibrated by a temperature, and the rejection threshold is set, on rows that training left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import keyed, mixed, real_id, slices, texts_of

PER_LANG, SAMPLE_ROWS, SAMPLE_CHARS, WINDOWS = 1500, 30_000, 20_000, 8
PIECE = 1 << 17
BUCKET_BITS, DIM, ORDERS, EPOCHS, RATE = 16, 16, (1, 2, 3), 8, 0.5
#: Of rows that the classifier gets right, the share that calibration may reject, and the highest threshold.
LOST, HIGHEST = 0.001, 0.5
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For each code point up to U+FFFF its lower case, or 0 if it is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of the texts with 32 in place of all else and one 32 around each word, and each text's end."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    ends = np.cumsum([len(t) + 2 for t in texts])
    codes = np.frombuffer(("".join(f" {t} " for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        low[high] = [c if chr(c).isalpha() else 0 for c in codes[high].tolist()]
    space = low == 0
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first of each run of others
    keep[0] = keep[ends[:-1]] = True
    low[space] = 32
    return low[keep], np.cumsum(keep)[ends - 1]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams (those of white space alone and across texts left out), the text of each, and each text's letters."""
    codes, ends = _folded(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    letters = np.bincount(owner[codes != 32], minlength=len(texts))
    buckets, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
        if n in ORDERS:
            inner = codes[1 : len(codes) - n + 2] if n > 2 else codes[: len(codes) - n + 1]
            good = (owner[n - 1 :] == owner[: len(h)]) & ((inner[: len(h)] != 32) if n != 2 else (codes[:-1] != 32) | (codes[1:] != 32))
            buckets.append((mixed(h[good] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owners.append(owner[: len(h)][good])
    return np.concatenate(buckets), np.concatenate(owners), letters


def _pieces(texts: list[str], size: int = PIECE) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts in groups of about `size` characters, with the text that each piece is of.

    Texts are cut before characters that are no letters. No subword reaches over one, so the pieces' subwords are
    those of the whole text.
    """
    group, owner, held = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            to = at + size
            while to < len(text) and text[to].isalpha():
                to += 1
            group.append(text[at:to])
            owner.append(k)
            held += len(group[-1])
            at = max(to, 1)
            if held >= size:
                yield group, np.array(owner)
                group, owner, held = [], [], 0
    if group:
        yield group, np.array(owner)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets, langs): each bucket's embedding times the linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: a row of logits and the number of letters."""
        n = len(texts)
        sums, total, letters = np.zeros((n, len(self.langs))), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for pieces, of_text in _pieces(texts):
            bucket, piece, found = subwords(pieces)
            owner = of_text[piece]
            total += np.bincount(owner, minlength=n)
            np.add.at(letters, of_text, found)
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(owner, weights=self.table[bucket, k], minlength=n)
        return sums / total.clip(1)[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, calibrated scores, and which are rejected."""
        z, letters = self.logits(texts)
        p = _softmax(z / self.temperature)
        score = np.where(letters > 0, p.max(1), 0.0)
        lang = [self.langs[k] if n else UNKNOWN for k, n in zip(p.argmax(1).tolist(), letters.tolist(), strict=True)]
        return lang, score, (letters == 0) | (score < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent over the texts in a seeded order; every fifth text of a language calibrates instead."""
    langs = sorted(set(labels))
    if not langs:
        return Model([UNKNOWN], np.zeros((1 << BUCKET_BITS, 1)), np.zeros(1))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1 / DIM, (1 << BUCKET_BITS, DIM))
    layer, bias = rng.normal(0, 1 / DIM, (DIM, len(langs))), np.zeros(len(langs))
    bags = []
    for k, t in enumerate(texts):
        bucket, _, _ = subwords([t])
        bags.append((*np.unique(bucket, return_counts=True), k))
    bags = [(b, c / c.sum(), k) for b, c, k in bags if len(b)]
    seen = np.zeros(len(langs), np.int64)
    aside, fit = [], []
    for x in bags:
        seen[y[x[2]]] += 1
        (fit if seen[y[x[2]]] % 5 else aside).append(x)
    steps = EPOCHS * len(fit)
    for step in range(steps):
        if step % len(fit) == 0:
            order = rng.permutation(len(fit))
        b, c, k = fit[order[step % len(fit)]]
        rate = RATE * (1 - step / steps)
        mean = c @ embed[b]
        p = _softmax((mean @ layer + bias)[None])[0]
        p[y[k]] -= 1
        embed[b] -= (rate * len(b) ** 0.5) * c[:, None] * (layer @ p)
        layer -= rate * np.outer(mean, p)
        bias -= 0.1 * rate * p
    model = Model(langs, embed @ layer, bias)
    aside = [k for *_, k in aside or bags]
    if aside:
        z = model.logits([texts[k] for k in aside])[0]
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(aside)), y[aside]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
        p = _softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[aside]]
        if len(right):
            model.threshold = float(min(HIGHEST, np.quantile(right, LOST)))
    return model


def _learned(text: Column) -> Column:
    """The text, or of a long one WINDOWS windows spread from its first to its last character."""
    size = SAMPLE_CHARS // WINDOWS
    step = (F.length(text) - size) / F.lit(WINDOWS - 1)
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(text, (F.floor(k * step) + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(windows, " "))


def sample(docs: DataFrame, where: Column | bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """Distinct texts and labels of up to `per_lang` labelled rows of each language, those of the least hashes of id and text.

    Every language that a row has is learned. The driver holds one count for each, and SAMPLE_ROWS texts, or one for
    each language if there are more of those.
    """
    # an inner frame with fixed names, as docs may have columns of any name
    rows = docs.where(F.lit(where) if isinstance(where, bool) else where).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // len(counts)))
    # a share a little too large, of which the least hashes are taken
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.2 * per_lang + 20) / n))))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) / 1_000_003.0
    drawn = rows.select("lang", draw.alias("draw"), "text").where(F.col("draw") < share[F.col("lang")]).select("lang", "draw", _learned(F.col("text")).alias("text")).distinct()
    least = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("at") <= per_lang)
    kept = sorted({(r["text"], r["lang"]) for r in least.select("text", "lang").collect()})
    return [t for t, _ in kept], [x for _, x in kept]


def fit(docs: DataFrame, where: Column | bool = True, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    return train(*sample(docs, where, id_col, text_col, lang_col, per_lang))


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row.

    Null texts and texts without a letter are `und` with score 0, and rejected. Without labelled rows to learn
    from every text is `und`. Rows with null or repeated doc_id come out as they are. Other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            lang, score, rejected = model.predict([t.decode() for t in texts_of(part, "_text")])
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_tag"), pa.array(lang), pa.array(score), pa.array(rejected)], names=["_id", "_tag", "lang_pred", "score", "rejected"])

    made = keyed(docs, id_col, text_col).mapInArrow(rows, "_id long, _tag long, lang_pred string, score double, rejected boolean")
    return made.select(real_id(), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known; judged where they are read, without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.filter(pa.array(~model.predict([t.decode() for t in texts_of(part, text_col)])[2]))

    return docs.mapInArrow(rows, docs.schema)
