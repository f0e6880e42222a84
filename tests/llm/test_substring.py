"""Passage removal over texts made to make hashes collide, and its parts against plain Python."""

import random

import numpy as np
import pytest

from tidemark.llm import common, substring


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a


@pytest.mark.parametrize("hot", [substring.HOT, 0])
def test_words_that_break_hashes_modulo_powers_of_two(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{rest} {a}"), (4, f"{rest} {b}"), (5, f"{a} {rest}")]
    # whole sequences of words that are Thue-Morse words over two words
    x, y = a[:1024].replace("a", "x ").replace("b", "y "), b[:1024].replace("a", "x ").replace("b", "y ")
    got = {r.doc_id: r.n_removed for r in substring.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    wide = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r.n_removed for r in substring.drop_repeated_passages(wide, width=1024).collect()} == {0}


def test_rolling():
    rng = random.Random(2)
    p = 2**61 - 1
    values = [rng.randrange(p) for _ in range(60)] + [p - 1] * 25 + [0] * 10
    for width in (1, 2, 3, 4, 19, 20, 31, 95, 96):
        got = common.rolling(np.array(values, np.uint64), width, common.BASES[1]).tolist()
        want = []
        for k in range(len(values) - width + 1):
            h = 0
            for v in values[k : k + width]:
                h = (h * common.BASES[1] + v) % p
            want.append(h)
        assert got == want


def test_without_spans_in_pieces(monkeypatch):
    rng = random.Random(3)
    words = [rng.choice(["a", "bc", "déf", "g" * 40]) + str(k) for k in range(500)]
    text = "  ".join(words).encode() + b"\n"
    cuts = sorted(rng.sample(range(501), 40))
    spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    want = " ".join(w for k, w in enumerate(words) if not any(a <= k < b for a, b in spans)).encode()
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(common.words_of, "__defaults__", (size,))
        assert substring._without(text, spans) == (500, want)
        assert substring._without(text, []) == (500, b" ".join(w.encode() for w in words))
        assert substring._without(b" \n", []) == (0, b"")
        first, second, counts = common.word_hashes([text, b"", b"a a"])
        assert counts.tolist() == [500, 0, 2] and len(first) == len(second) == 502 and first[-1] == first[-2] != first[0]
