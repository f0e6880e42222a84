"""Tokenizer alignment against whole-text encodings by the two libraries and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import align, queries

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "Hello, world!  It's 12345 \n\n new\tlines \r\n end ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "x\x00y", "é ﬁ É",
    "日本語のテキスト と English", "😀 emojis 👩‍👩‍👧 x", "a\x1c b\x85 c  d　e", "​ a ﻿ b", "ﷺ unusual", "word " * 300, "q" * 3000, "don't  stop ... !!! %%% && the the the", "The The The", "᠎ x", "a  b",
]
SCHEMA = "doc_id long, text string, share int, groups string, uid string"


def expected(rows):
    a_model = Tokenizer.from_file(queries.tokenizer_path())
    a_model.encode_special_tokens = True
    from tidemark.llm.bpe import byte_alphabet

    letters = byte_alphabet()
    b_model = sentencepiece.SentencePieceProcessor(model_file=queries.pieces_path())

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            of_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
            of_b = [b_bytes(i) for i in b]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                groups = [([i for i, e in zip(a, ends_a, strict=True) if lo < e <= hi], [i for i, e in zip(b, ends_b, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(links.keys())
        found.append((doc_id, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, links in found:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), text))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    return [*enumerate(TEXTS), *real, (None, "a b c"), (None, "a b c"), (3, "again"), (3, "again"), (3, None)]


@pytest.fixture(scope="module")
def want(rows):
    return expected(rows)


@pytest.mark.parametrize("limit", [align.BROADCAST_BYTES, -1])
def test_alignments(spark, rows, want, limit):
    df = spark.createDataFrame([(*r, 1, "g", "u") for r in rows], SCHEMA).repartition(3)
    got = align.alignments(df, queries.tokenizer_path(), queries.pieces_path(), broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("limit", [align.BROADCAST_BYTES, -1])
def test_no_rows(spark, limit):
    got = align.alignments(spark.createDataFrame([], SCHEMA), queries.tokenizer_path(), queries.pieces_path(), broadcast_bytes=limit)
    assert got.collect() == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in expected(rows)), key=str)
    assert sorted(map(tuple, queries.tokenizer_alignment(spark, sf_dir).collect()), key=str) == want


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(align, "MEMO_BYTES", 1000)
    made, fresh = align.Aligner(queries.tokenizer_path(), queries.pieces_path()), align.Aligner(queries.tokenizer_path(), queries.pieces_path())
    for k in range(5):
        texts = [f"text {k} of some words {j}" for j in range(20)]
        links, where, ends, _ = made.texts_of(texts, True)
        more, other, _, _ = fresh.texts_of(texts, True)
        assert align.text_sums(links.stats, where, ends).tolist() == align.text_sums(more.stats, other, ends).tolist()
        assert align._joined(links, where, ends) == align._joined(more, other, ends)
        assert len(made.slots) <= 150


def test_encoders_of_a_agree():
    """By ranks and by merges, over random texts of many alphabets; unequal ids would change the result."""
    rng = random.Random(8)
    c = align.Aligner(queries.tokenizer_path(), queries.pieces_path())
    assert c.ranked is not None
    pools = ["abcdefghi th", "aàâäéèê ß.,", "\n\t \r xX1", "日本語の漢字ひ ", "0123456789 .-", "ÀÉ İı ſK", "\u2028\u180e\x85\x1c a ", "😀👩‍👧 é"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60))) for _ in range(3000)] + ["".join(rng.choice(p) for _ in range(80)) for p in pools for _ in range(40)]
    by_ranks = [np.array(c.ranked(f" {t}"), "<u4").tobytes() for t in texts]
    assert by_ranks == c.a.encode([f" {t}" for t in texts])
    c.ranked = None
    d = align.Aligner(queries.tokenizer_path(), queries.pieces_path())
    for x, y in zip(c.texts_of(texts, True)[0].groups, d.texts_of(texts, True)[0].groups, strict=True):
        assert x == y


def test_groups_with_very_many_links():
    """A group of over 4,096 links is counted by its distinct pairs."""
    c = align.Aligner(queries.tokenizer_path(), queries.pieces_path())
    c.b_bytes = [b"x" * 101 if i == 5 else x for i, x in enumerate(c.b_bytes)]
    c.sizes[1] = np.array([len(x) for x in c.b_bytes])
    slots = np.array([0])
    c.ids[0].add(np.array([c.a.byte_ids[120]] * 101 * 70), np.array([101 * 70]))
    c.ids[1].add(np.array([5] * 70), np.array([70]))
    c.sizes[0] = np.where(np.arange(len(c.sizes[0])) == c.a.byte_ids[120], 1, c.sizes[0])
    links = c.linked(slots, True)
    assert links.stats.tolist() == [[7070, 70, 70, 7070]]
    c.sizes[1][5] = 99
    c.ids[1].add(np.array([5] * 70 + [6]), np.array([71]))
    c.sizes[1][6] = 7070 - 99 * 70
    c.ids[0].add(np.array([c.a.byte_ids[120]] * 7070), np.array([7070]))
    c.sizes[0][c.a.byte_ids[120]] = 1
    whole = c.linked(np.array([1]), False)
    assert whole.stats.tolist()[0][3] == whole.times.sum()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 48, n, replace=False).astype(np.int64)
    made = align.PerfectHash.build(keys)
    assert sorted(made.index(keys).tolist()) == list(range(n))
    assert (made.index(keys + (1 << 50)) < n).all()
    assert 64 * len(made.words) <= 6 * n + 4096
