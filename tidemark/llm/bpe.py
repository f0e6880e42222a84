"""Byte-level BPE, encoded by forced-boundary splitting, and its decoding.

A merge joins two neighbouring byte strings to a token, so two bytes that stand side by side in no token of the
vocabulary are never merged across: between them a cut is certain. A text is first split as the tokenizer's own
pattern splits it, each piece is cut at all such byte pairs, the fragments are encoded independently by the
merge ranks, and the ids are concatenated. Pieces and fragments recur, so tasks keep a bounded memo of both.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.common import keyed, real_id, slices, texts_of

#: Bytes that a worker's memo may take, by estimate, and the longest piece in it.
MEMO_BYTES, MEMO_PIECE = 72 << 20, 64
#: The byte-level alphabet's rule: printable bytes stand for themselves, the others follow from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in _PRINTABLE]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}


#: The split pattern that the vocabulary was made with, for texts of ASCII and Latin letters up to U+024F.
_LATIN = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
_NUMBER = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
_PATTERN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LATIN}]+| ?[{_NUMBER}]+| ?[^\s{_LATIN}{_NUMBER}]+|\s+(?!\S)|\s+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Such texts. U+001C to U+001F are left out: they are white space to re alone.
_COVERED = re.compile(r"[\t-\r -ɏ]*\Z")


class Codec:
    """Encodes and decodes with a tokenizer file of byte-level BPE; made once for each Python worker."""

    def __init__(self, path: str, special: bool = True, memo_bytes: int = MEMO_BYTES):
        """special: whether a special token's string in a text is that token, or text like any other."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError("the file is not a byte-level BPE without normaliser")
        self.letters = letters = byte_alphabet()
        self.library = Tokenizer.from_file(path)
        self.splitter = self.library.pre_tokenizer  # for the texts that _PATTERN doesn't cover
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [tuple(as_bytes(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.vocab = set(vocab.values()) - {t["id"] for t in spec["added_tokens"]}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added if special else {}
        self.splits = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        by_id = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            for pair in pairwise(token):
                self.joined[pair] = True
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)])
        self.size = len(self.tokens)
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges])
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.merged = pairs[order], order, np.array([vocab[a + b] for a, b in merges])[order]
        self.by_pair: dict[int, tuple[int, int]] = {}  # of a pair its rank and token; made for the first long fragment
        self.memo_bytes = memo_bytes
        self._forget()

    def _forget(self) -> None:
        self.memo = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.held = self.seen = self.missed = 0

    def _remember(self, made: dict[str, bytes]) -> None:
        """Adds short pieces while there is room; objects and their place in the memo take some 180 bytes each."""
        if self.held < self.memo_bytes:
            kept = {p: ids for p, ids in made.items() if len(p) <= MEMO_PIECE}
            self.memo.update(kept)
            self.held += sum(180 + len(p) + len(ids) for p, ids in kept.items())

    def pieces(self, text: str) -> list[str]:
        """The text as the tokenizer splits it before merging; a special token is a piece of its own."""
        if self.splits is not None and self.splits.search(text):
            return [p for x in self.splits.split(text) for p in ([x] if x in self.special else self.pieces(x))]
        if _COVERED.match(text):
            return _PATTERN.findall(text)
        return [bytes(self.letters[c] for c in p).decode() for p, _ in self.splitter.pre_tokenize_str(text)]

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair of ids would be among the merges, and whether it is there."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return at, self.pairs[at] == key

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Forced-boundary encoding of many pieces at once: every fragment takes its next merge in the same numpy step."""
        return self._encode_raw([p.encode() for p in pieces])

    def _encode_raw(self, raw: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        cut = np.ones(len(data), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | ~self.joined[data[:-1], data[1:]]
        fragment, ids = np.cumsum(cut) - 1, self.byte_ids[data]
        of_fragment = owner[cut]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.bincount(fragment)
        first = np.cumsum(size) - size
        for f in np.flatnonzero(size > 256):
            done.append((merged := self._merge_long(ids[first[f] : first[f] + size[f]].tolist()), np.full(len(merged), f)))
        short = (size <= 256)[fragment]
        fragment, ids = fragment[short], ids[short]
        while len(ids):
            pair, known = self._found(ids[:-1], ids[1:])
            known &= fragment[1:] == fragment[:-1]
            n = len(ids)
            score = np.full(n, np.iinfo(np.int64).max)
            score[:-1][known] = self.ranks[pair[known]] * n + np.flatnonzero(known)
            head = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
            best = np.minimum.reduceat(score, head)
            more = best < np.iinfo(np.int64).max
            at = best[more] % n
            ids[at] = self.merged[pair[at]]
            keep = np.repeat(more, np.diff(np.append(head, n)))
            if not more.all():
                done.append((ids[~keep], fragment[~keep]))
            keep[at + 1] = False
            ids, fragment = ids[keep], fragment[keep]
        ids, fragment = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(fragment, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(of_fragment[fragment], minlength=len(raw)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, ids: list[int]) -> np.ndarray:
        """The same merges with a heap of neighbouring pairs, for fragments of any length."""
        if not self.by_pair:
            self.by_pair = dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        ranks, n = self.by_pair, len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[key][0], k, key) for k in range(n - 1) if (key := ids[k] * self.size + ids[k + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, key = heapq.heappop(heap)
            if ids[k] < 0 or right[k] >= n or ids[k] * self.size + ids[right[k]] != key:
                continue
            gone = right[k]
            ids[k], ids[gone], right[k] = ranks[key][1], -1, right[gone]
            if right[k] < n:
                left[right[k]] = k
            for i in (left[k], k):
                if i >= 0 and right[i] < n and (key := ids[i] * self.size + ids[right[i]]) in ranks:
                    heapq.heappush(heap, (ranks[key][0], i, key))
        return np.array([i for i in ids if i >= 0])

    def as_ranks(self) -> Callable[[str], list[int]] | None:
        """An encoder of whole texts by ranks, special tokens being text like any other; None where it could differ from the merges.

        It merges any two neighbours that make a token, the least id first. That is the same where ids rise with the
        merges, and the bytes of each token alone are merged to that token: two neighbours that make a token are then
        a state of that token's own merging, whose last step joins them.
        """
        import tiktoken

        order = np.argsort(self.ranks)
        vocab = sorted(self.vocab)
        made = self._encode_raw([self.tokens[i] for i in vocab])
        if (np.diff(self.merged[order]) <= 0).any() or self.byte_ids.max() >= self.merged.min() or any(m != np.array([i], "<u4").tobytes() for i, m in zip(vocab, made, strict=True)):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.tokens[i]: i for i in vocab}, special_tokens={})._core_bpe.encode_ordinary

    def library_pieces(self, pieces: list[str]) -> list[bytes]:
        """The same by the tokenizers library's own model."""
        alphabet = {b: c for c, b in self.letters.items()}
        tokenize = self.library.model.tokenize
        return [np.array([t.id for t in tokenize(p.encode().decode("latin-1").translate(alphabet))], "<u4").tobytes() for p in pieces]

    def encode(self, texts: list[str], missing: Callable[[list[str]], list[bytes]] | None = None) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers. `missing` encodes the pieces that the memo lacks."""
        split = [self.pieces(t) for t in texts]
        flat = list(chain.from_iterable(split))
        got = list(map(self.memo.get, flat))
        gaps = [k for k, x in enumerate(got) if x is None]
        if gaps:
            new = list(dict.fromkeys(flat[k] for k in gaps))
            made = dict(zip(new, (missing or self.encode_pieces)(new), strict=True))
            for k in gaps:
                got[k] = made[flat[k]]
            self._remember(made)
            self.seen, self.missed = self.seen + len(flat), self.missed + len(gaps)
            if self.seen > 5_000_000:  # if the memo is full and the texts have changed, begin again
                if self.held >= self.memo_bytes and self.missed > 0.25 * self.seen:
                    self._forget()
                self.seen = self.missed = 0
        ends = list(accumulate(map(len, split)))
        return [b"".join(got[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError("an id is outside the vocabulary")
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(path: str, decode: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches, "_text"):
            raw = c.encode([t.decode() for t in texts_of(part, "_text")])
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) // 4 for r in raw)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_tag"), ids], names=["_id", "_tag", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches, "_text"):
            made = [np.frombuffer(r, "<u4") for r in c.encode([t.decode() for t in texts_of(part, "_text")])]
            of_ids = [hashlib.sha256(",".join(map(c.decimals.__getitem__, m.tolist())).encode()).hexdigest() for m in made]
            of_text = [hashlib.sha256(c.decode(m).encode()).hexdigest() for m in made]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_tag"), pa.array([len(m) for m in made], pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["_id", "_tag", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests if decode else rows


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text; a null text is empty and has none.

    Equal to the tokenizers library's encoding with add_special_tokens=False: a special token's string in a
    text is that token. Rows with null or repeated doc_id come out as they are. Other columns are ignored.
    """
    return keyed(docs, id_col, text_col).mapInArrow(_encoded(path, False), "_id long, _tag long, ids array<int>").select("_id", "_tag", real_id(), "ids")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; no ids give an empty text, a null among them none, an id outside the vocabulary is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(rows, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text they decode to; both steps run on the same slice."""
    schema = "_id long, _tag long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return keyed(docs, id_col, text_col).mapInArrow(_encoded(path, True), schema).select("_id", "_tag", real_id(), "n_tokens", "ids_sha256", "decoded_sha256")
