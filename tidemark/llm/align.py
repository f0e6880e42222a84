"""Alignment of two tokenizers' tokens over a corpus: byte-level BPE (A) beside a SentencePiece model (B).

A text's tokens are cut into groups where both tokenizers' tokens end at the same byte; tokens of one group are linked. How
many documents hold a pair of ids linked is counted over the corpus:

1. every task aligns its documents and adds up the documents that hold each distinct pair;
2. the distinct pairs, dealt by a hash of A's id, get a minimal perfect hash for each share: levels of bits, where a pair
   takes the first level in which its bit is its own, so that its rank among all bits is its index;
3. each task's counts become a dense vector by that index, and vectors are summed as a tree, some shares of a share first;
4. a second pass aligns the documents again and looks their pairs up. An index is trusted only if the key stored there is
   the pair. A table of up to `BROADCAST_BYTES` goes to all tasks; beyond that the pairs of slices of documents go to the
   share that knows them, and come back as sums.

Both tokenizers' tokens end before a space that follows no white space (A splits there, and no piece of B reaches over), so
a text is handled in units between such spaces, and a worker remembers the units that it has aligned.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Codec
from tidemark.llm.common import keyed, mixed, new_path, real_id, slices, texts_of

SHARES, SALTS = 64, 16
BROADCAST_BYTES = 96 << 20
#: Bytes of text that are aligned at once, of a worker's memory of units, by estimate, and of pairs that a task holds before it passes them on.
STEP, MEMO_BYTES, HELD = 1 << 20, 160 << 20, 1_500_000
#: Before a space, unless white space (or what some call so) stands before it.
_UNIT = re.compile(r"(?<=[^\s\u180e\u200b-\u200f\u2028-\u202f\u205f-\u2064\ufeff])(?= )")
#: What a text has none of if it can be split at each space: white space before a space, or a space at its end.
_ODD = re.compile(_UNIT.pattern.replace("(?<=[^", "[").replace("])(?= )", "] | $"))
_SHIFT = np.int64(32)
_GOLD = 0x9E3779B97F4A7C15


class Aligner:
    """Aligns texts unit by unit; made once for each Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Codec(path_a, special=False, memo_bytes=24 << 20)
        self.ranked = self.a.as_ranks()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_bytes = lambda i, p: bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        self.b_bytes = [as_bytes(i, p) for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in tokens]) for tokens in (self.a.tokens, self.b_bytes)]
        #: of each id its text with what may follow it: inside a group, and at the end of the group's ids
        self.texts = [[np.array([f"{i}{mark}" for i in range(len(size))], object) for mark in marks] for size, marks in zip(self.sizes, (",|", ",;"), strict=True)]
        self.space = self.b.piece_to_id("▁")
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and self.b_bytes[self.space] == b" "
        self.values_of = ""
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}  # of each unit without the space that it begins with
        self.ids = [_Pool(), _Pool()]
        self.values, self.valued = np.zeros((1 << 12, 2), np.int64), np.zeros(1 << 12, bool)  # best flags and counts of a unit's links, summed, where known
        self.good = np.zeros(1 << 12, bool)  # whether a unit's tokens give its bytes
        self.held = 0

    def _encode_a(self, units: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, and the number of each unit's."""
        if self.ranked is None:
            raw = self.a.encode(units)
            return np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw])
        # in one text: a unit begins with a space, before which A splits unless white space ends the unit before
        apart = {c for c in {u[-1] for u in units} if not _UNIT.match(f"{c} ", 1)}
        if not apart:
            ids = np.array(self.ranked("".join(units)), np.int64)
            return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[0][ids]), np.cumsum(lengths), side="right"), prepend=0)
        alone = np.array([u[-1] in apart for u in units])
        together = np.flatnonzero(~alone).tolist()
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
        if together:
            ids, counts = self._encode_a([units[k] for k in together], lengths[together])
            for k, x in zip(together, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                found[k] = x
        for k in np.flatnonzero(alone).tolist():
            found[k] = np.array(self.ranked(units[k]), np.int64)
        return np.concatenate(found), np.array([len(x) for x in found])

    def _learn(self, names: list[str]) -> None:
        """names: the units without the space that each begins with."""
        n, units = len(self.slots), [f" {u}" for u in names]
        of_b = self.b.encode(names, num_threads=1)
        if "" in names:
            of_b[names.index("")] = [self.space]
        raw = [u.encode() for u in units]
        lengths = np.array([len(r) for r in raw])
        flat, counts = self._encode_a(units, lengths)
        self.ids[0].add(flat, counts)
        counts_b = np.array([len(x) for x in of_b])
        flat_b = np.fromiter(chain.from_iterable(of_b), np.int64, counts_b.sum())
        self.ids[1].add(flat_b, counts_b)
        total = np.concatenate([[0], np.cumsum(self.sizes[1][flat_b])])
        ends = np.cumsum(counts_b)
        good = total[ends] - total[ends - counts_b] == lengths
        given = list(map(self.b_bytes.__getitem__, flat_b.tolist()))
        if not good.all() or b"".join(given) != b"".join(raw):
            good = np.array([b"".join(given[e - c : e]) == r for e, c, r in zip(ends, counts_b, raw, strict=True)])
        while len(self.good) < n + len(units):
            self.good, self.values, self.valued = (np.concatenate([x, np.zeros_like(x)]) for x in (self.good, self.values, self.valued))
        self.good[n : n + len(units)] = good
        self.slots.update(zip(names, range(n, n + len(units)), strict=True))
        self.held += 200 * len(units) + int(lengths.sum()) + 4 * (len(flat) + len(flat_b))

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the texts' units, one text after the other, and each text's end among them. An empty text has none."""
        if self.held > MEMO_BYTES:
            self.forget()
        split = [self._split(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        found = list(map(self.slots.get, flat))
        if None in found:
            gaps = [k for k, x in enumerate(found) if x is None]
            self._learn(list(dict.fromkeys(map(flat.__getitem__, gaps))))
            for k in gaps:
                found[k] = self.slots[flat[k]]
        return np.array(found, np.int64), np.cumsum([len(s) for s in split])

    def _split(self, text: str) -> list[str]:
        """The text's units, each without the space that it begins with."""
        if not self.cuts:
            return [text]
        if text[0] != " " and not _ODD.search(text):
            return text.split(" ")  # no space but such as a unit begins with
        return [u[1:] for u in _UNIT.split(f" {text}")]

    def linked(self, slots: np.ndarray, texts: bool, pairs_too: bool = True) -> Links:
        """The alignment of good units; without pairs_too, no pairs."""
        (a, n_a), (b, n_b) = (pool.take(slots) for pool in self.ids)
        at_a, at_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        size = int(at_a[-1]) if len(at_a) else 0
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[at_a] = in_b[at_b] = True
        last_a, last_b = in_b[at_a], in_a[at_b]  # the last tokens of groups
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        unit = np.repeat(np.arange(len(slots)), n_a)[last_a]
        own_a, own_b = np.bincount(group_a), np.bincount(group_b)
        product = own_a * own_b
        stats = np.stack([n_a, n_b, np.bincount(unit, minlength=len(slots)), np.bincount(unit, weights=product, minlength=len(slots)).astype(np.int64)], 1)
        first_a, first_b = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b
        small = np.flatnonzero(product <= (4096 if pairs_too else -1))
        many = product[small]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        wide = np.repeat(own_b[small], many)
        pairs = [a[np.repeat(first_a[small], many) + within // wide] << _SHIFT | b[np.repeat(first_b[small], many) + within % wide]]
        times, owner = [np.ones(len(within), np.int64)], [np.repeat(unit[small], many)]
        for g in np.flatnonzero(product > 4096).tolist() if pairs_too else []:  # their distinct pairs alone
            x, n = np.unique(a[first_a[g] : first_a[g] + own_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + own_b[g]], return_counts=True)
            pairs.append((x[:, None] << _SHIFT | y).ravel())
            times.append(np.outer(n, m).ravel())
            owner.append(np.full(len(x) * len(y), unit[g]))
        pairs, times, owner = map(np.concatenate, (pairs, times, owner))
        if len(owner) > len(within):
            order = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[order], times[order], owner[order]
        groups: list[str] = []
        if texts:
            both = np.empty(len(a) + len(b), object)
            both[np.arange(len(a)) + first_b[group_a]] = np.where(last_a, self.texts[0][1][a], self.texts[0][0][a])
            both[np.arange(len(b)) + first_a[group_b] + own_a[group_b]] = np.where(last_b, self.texts[1][1][b], self.texts[1][0][b])
            flat, ends = both.tolist(), np.cumsum(n_a + n_b).tolist()
            groups = ["".join(flat[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
        return Links(stats, pairs, times, np.searchsorted(owner, np.arange(len(slots) + 1)), groups)

    def texts_of(self, texts: list[str], groups: bool, pairs_too: bool = True) -> tuple[Links, np.ndarray, np.ndarray, np.ndarray]:
        """The links of the texts' distinct good units, the unit of each place in the texts, each text's end, and the units' slots.

        A text with a unit whose tokens don't give its bytes has none.
        """
        slots, ends = self.units(texts)
        bad = np.concatenate([[0], np.cumsum(~self.good[slots])])
        starts = np.concatenate([[0], ends[:-1]])
        has = (ends > starts) & (bad[ends] == bad[starts])
        slots = slots[np.repeat(has, ends - starts)]
        own, where = np.unique(slots, return_inverse=True)
        return self.linked(own, groups, pairs_too), where, np.cumsum(np.where(has, ends - starts, 0)), own


class _Pool:
    """Lists of ids, one after the other."""

    def __init__(self):
        self.ids, self.ends, self.n, self.size = np.zeros(1 << 14, np.int32), np.zeros((1 << 12) + 1, np.int64), 0, 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(counts) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(counts)] = self.size + np.cumsum(counts)
        self.size, self.n = self.size + len(ids), self.n + len(counts)

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists, and the number of each."""
        first = self.ends[slots]
        counts = self.ends[slots + 1] - first
        return self.ids[np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)].astype(np.int64), counts


@dataclass
class Links:
    """Of some units: numbers of tokens of A and B, groups and links; the linked pairs of ids, how often each is, where each unit's begin; groups as text."""

    stats: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    starts: np.ndarray
    groups: list[str]

    def of(self, units: np.ndarray) -> np.ndarray:
        """The places of these units' pairs."""
        counts = self.starts[units + 1] - self.starts[units]
        return np.arange(counts.sum()) + np.repeat(self.starts[units] - (np.cumsum(counts) - counts), counts)


def text_sums(values: np.ndarray, where: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each text the sum of its units' values."""
    total = np.zeros((len(where) + 1, values.shape[1]), np.int64)
    np.cumsum(values[where], axis=0, out=total[1:])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def share_of(pairs: np.ndarray) -> np.ndarray:
    """All pairs of one id of A are in one share."""
    return (mixed((pairs >> _SHIFT).astype(np.uint64)) % np.uint64(SHARES)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: words of bits, level after level, and the ranks of the words."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64) if len(words) else np.zeros(0, np.int64)

    @staticmethod
    def _places(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return mixed(mixed(keys) + np.uint64((level + 1) * _GOLD % 2**64)) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, rest = [], [], keys.astype(np.uint64)
        while len(rest):
            n = -(-len(rest) // 32)  # two bits a key
            place = cls._places(rest, len(sizes), n).astype(np.int64)
            alone = np.bincount(place, minlength=64 * n) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n)
            rest = rest[~alone[place]]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key of the set, from 0; of any other key some index or -1."""
        keys = keys.astype(np.uint64)
        out, rest, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes):
            if not len(rest):
                break
            place = self._places(keys[rest], level, n)
            word, bit = base + (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            rest, base = rest[~hit], base + n
        return out


class Share:
    """One share's table: the perfect hash, and by index the pair, its count and whether no pair of its id of A has a higher one."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(list(row["sizes"]), np.frombuffer(row["words"], "<u8"))
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.counts = np.frombuffer(row["counts"] or b"", "<i8")
        self.best = np.frombuffer(row["best"] or b"", bool)

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """Indexes of pairs that the table must hold."""
        at = self.hash.index(pairs)
        if len(at) and (at.min() < 0 or (self.keys[at] != pairs).any()):
            raise RuntimeError("a pair is missing in its share's table")
        return at

    def values(self, pairs: np.ndarray) -> np.ndarray:
        at = self.index(pairs)
        return np.stack([self.best[at].astype(np.int64), self.counts[at]], 1)


_COUNTS = "share int, salt int, pairs binary, counts binary"
_TABLE = "share int, sizes array<int>, words binary, keys binary, counts binary, best binary"


def _batch(schema: list[tuple[str, pa.DataType]], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _by_share(pairs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    share = share_of(pairs)
    order = np.argsort(share, kind="stable")
    ends = np.cumsum(np.bincount(share, minlength=SHARES))
    for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if a < b:
            yield s, pairs[order[a:b]], counts[order[a:b]]


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their counts."""
    keys, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _document_counts(path_a: str, path_b: str):
    """The number of documents that hold each distinct pair, added up over a task's documents."""

    def flushed(pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        rows = [(s, (s + len(p)) % SALTS, p.astype("<i8").tobytes(), c.astype("<i8").tobytes()) for s, p, c in _by_share(pairs, counts)]
        return _batch([("share", pa.int32()), ("salt", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())], list(map(list, zip(*rows, strict=True))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = aligner(path_a, path_b)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in slices(batches, "_text", STEP):
            links, where, ends, _ = c.texts_of([t.decode() for t in texts_of(part, "_text")], False)
            found = [np.unique(links.pairs[links.of(np.unique(where[a:b]))]) for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]
            if found:
                new = np.concatenate(found)
                pairs, counts = _summed([pairs, new], [counts, np.ones(len(new), np.int64)])
            if len(pairs) > HELD:
                yield flushed(pairs, counts)
                pairs, counts = pairs[:0], counts[:0]
        if len(pairs):
            yield flushed(pairs, counts)

    return rows


def _runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, dict]]:
    """The rows one at a time, with their values of `by`; then a last one of None."""
    for batch in batches:
        for row in batch.to_pylist():
            yield tuple(row[b] for b in by), row
    yield None, {}


def _merged(*by: str):
    """The distinct pairs of each value of `by`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, known = None, [], 0, 0
        for now, row in _runs(batches, *by):
            if now != key and held:
                keys = np.unique(np.concatenate(held))
                yield _batch([("share", pa.int32()), ("pairs", pa.binary())], [[key[0]], [keys.tobytes()]])
                held, size, known = [], 0, 0
            key = now
            if row:
                held.append(np.frombuffer(row["pairs"], "<i8"))
                size += len(held[-1])
                if size > 2 * known + HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = known = len(held[0])

    return rows


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A perfect hash of each share's distinct pairs, with the pairs in the order of their index."""
    for batch in batches:
        for row in batch.to_pylist():
            pairs = np.frombuffer(row["pairs"], "<i8")
            made = PerfectHash.build(pairs)
            keys = np.empty_like(pairs)
            keys[made.index(pairs)] = pairs
            kinds = [("share", pa.int32()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())]
            yield _batch(kinds, [[row["share"]], [made.sizes], [made.words.tobytes()], [keys.tobytes()], [None], [None]])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each share and salt a dense vector of counts by index. The share's table comes before its counts."""
    key, share, total = None, None, None
    for now, row in _runs(batches, "share", "salt"):
        if now != key and total is not None:
            yield _batch([("share", pa.int32()), ("counts", pa.binary())], [[key[0]], [total.tobytes()]])
            total = None
        if now != key and row:
            share = Share(row)
            key = now
        elif row:
            total = np.zeros(len(share.keys), np.int64) if total is None else total
            total[share.index(np.frombuffer(row["pairs"], "<i8"))] += np.frombuffer(row["counts"], "<i8")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each share's table with the sum of its vectors. The table comes before them."""

    def ended(row: dict, total: np.ndarray) -> pa.RecordBatch:
        a = np.frombuffer(row["keys"], "<i8") >> _SHIFT
        _, where = np.unique(a, return_inverse=True)
        highest = np.zeros(where.max(initial=-1) + 1, np.int64)
        np.maximum.at(highest, where, total)
        kinds = [("share", pa.int32()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())]
        return _batch(kinds, [[row["share"]], [row["sizes"]], [row["words"]], [row["keys"]], [total.tobytes()], [(total == highest[where]).tobytes()]])

    table, total = None, None
    for _, row in _runs(batches, "share"):
        if not row or row["keys"] is not None:
            if table:
                yield ended(table, total)
            if row:
                table, total = row, np.zeros(len(row["keys"]) // 8, np.int64)
        else:
            total += np.frombuffer(row["counts"], "<i8")


def _stored(df: DataFrame, name: str) -> DataFrame:
    out = new_path(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _first(*frames: DataFrame, by: list[str]) -> DataFrame:
    """The frames' rows dealt by `by`, those of an earlier frame before those of a later."""
    all_rows = None
    for k, df in enumerate(frames):
        df = df.withColumn("_turn", F.lit(k))
        all_rows = df if all_rows is None else all_rows.unionByName(df, allowMissingColumns=True)
    return all_rows.repartition(*by).sortWithinPartitions(*by, "_turn")


def pair_table(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each share of the distinct pairs: perfect hash, pairs, the documents that hold each, and best flags, by index.

    A row's text counts once for each pair it holds, so equal rows count as often as there are rows.
    """
    counts = _stored(keyed(docs, id_col, text_col).mapInArrow(_document_counts(path_a, path_b), _COUNTS), "pair-counts")
    distinct = counts.select("share", "salt", "pairs").repartition("share", "salt").sortWithinPartitions("share", "salt").mapInArrow(_merged("share", "salt"), "share int, pairs binary")
    distinct = distinct.repartition("share").sortWithinPartitions("share").mapInArrow(_merged("share"), "share int, pairs binary")
    hashed = _stored(distinct.mapInArrow(_hashed, _TABLE), "pair-hash")
    salted = hashed.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    vectors = _first(salted.drop("counts"), counts, by=["share", "salt"]).mapInArrow(_vectors, "share int, counts binary")
    return _stored(_first(hashed, vectors, by=["share"]).mapInArrow(_tables, _TABLE), "pair-table")


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ROWS = "_id long, _tag long, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", groups string"
_LINKS = "uid long, _id long, _tag long, n_a long, n_b long, n_groups long, n_links long, groups string, share int, salt int, uids binary, pairs binary, times binary"


def _named(groups: list[str], digest: bool) -> pa.Array:
    return pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups, pa.string())


def _looked_up(path_a: str, path_b: str, table, name: str, digest: bool):
    """Each document's row, by the broadcast table, which has a name of its own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shares = aligner(path_a, path_b), {}
        if c.values_of != name:
            c.values_of, c.valued = name, np.zeros_like(c.valued)
        for row in table.value:
            shares[row["share"]] = Share(row)
        for part in slices(batches, "_text", STEP):
            links, where, ends, slots = c.texts_of([t.decode() for t in texts_of(part, "_text")], True, False)
            new = slots[~c.valued[slots]]
            if len(new):
                c.values[new], c.valued[new] = _unit_values(c.linked(new, False), shares), True
            values = np.concatenate([links.stats, c.values[slots]], 1)
            sums, groups = text_sums(values, where, ends), _joined(links, where, ends)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_tag"), *map(pa.array, np.ascontiguousarray(sums.T)), _named(groups, digest)], names=["_id", "_tag", *_NUMBERS, "groups"])

    return rows


def _unit_values(links: Links, shares: dict[int, Share]) -> np.ndarray:
    """Of each unit the best flags and the counts of its links, summed."""
    found, share = np.zeros((len(links.pairs) + 1, 2), np.int64), share_of(links.pairs)
    order = np.argsort(share, kind="stable")
    for s, at in zip(*_cut(share[order]), strict=True):
        found[1 + order[at]] = shares[s].values(links.pairs[order[at]]) * links.times[order[at], None]
    found = np.cumsum(found, axis=0)
    return found[links.starts[1:]] - found[links.starts[:-1]]


def _joined(links: Links, where: np.ndarray, ends: np.ndarray) -> list[str]:
    """The groups of each text."""
    flat = list(map(links.groups.__getitem__, where.tolist()))
    return ["".join(flat[a:b])[:-1] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _cut(ordered: np.ndarray) -> tuple[list[int], list[slice]]:
    """The distinct values of an ordered array, and where each is."""
    values, first = np.unique(ordered, return_index=True)
    return values.tolist(), [slice(a, b) for a, b in zip(first, [*first[1:], len(ordered)], strict=True)]


def _dealt_links(path_a: str, path_b: str, digest: bool):
    """Rows of two kinds: each document's, and for each share the pairs of a slice's documents."""
    number = ("uid", "_id", "_tag", "n_a", "n_b", "n_groups", "n_links")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, uid = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        schema = pa.schema([*((n, pa.int64()) for n in number), ("groups", pa.string()), ("share", pa.int32()), ("salt", pa.int32()), ("uids", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary())])

        def batch(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for part in slices(batches, "_text", STEP):
            links, where, ends, _ = c.texts_of([t.decode() for t in texts_of(part, "_text")], True)
            n = part.num_rows
            sums = text_sums(links.stats, where, ends)
            columns = dict(zip(number[3:], np.ascontiguousarray(sums.T), strict=True))
            yield batch(n, uid=np.arange(uid, uid + n), _id=part.column("_id"), _tag=part.column("_tag"), groups=_named(_joined(links, where, ends), digest), **columns)
            owner, pairs, times = [], [], []
            for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if a < b:
                    own, often = np.unique(where[a:b], return_counts=True)
                    keys, often = _summed([links.pairs[at := links.of(own)]], [links.times[at] * np.repeat(often, links.starts[own + 1] - links.starts[own])])
                    owner.append(np.full(len(keys), uid + k))
                    pairs.append(keys)
                    times.append(often)
            if pairs:
                owner, pairs, times = map(np.concatenate, (owner, pairs, times))
                share = share_of(pairs)
                order = np.argsort(share, kind="stable")
                for s, at in zip(*_cut(share[order]), strict=True):
                    yield batch(1, share=[s], salt=[uid // n % SALTS], uids=[owner[order[at]].tobytes()], pairs=[pairs[order[at]].tobytes()], times=[times[order[at]].tobytes()])
            uid += n

    return rows


def _link_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document in each row its links' best flags and counts, summed. The share's table comes before."""
    share = None
    for key, row in _runs(batches, "share"):
        if key and row["keys"] is not None:
            share = Share(row)
        elif key:
            values = share.values(np.frombuffer(row["pairs"], "<i8")) * np.frombuffer(row["times"], "<i8")[:, None]
            uids, where = _cut(np.frombuffer(row["uids"], "<i8"))
            sums = np.add.reduceat(values, [at.start for at in where], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), *map(pa.array, np.ascontiguousarray(sums.T))], names=["uid", "n_best", "count_sum"])


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each row's whole text.

    groups: each group's ids of A, comma-separated, a bar and its ids of B; groups are separated by semicolons (digest: their
    SHA-256 instead). n_links: pairs of tokens of A and B in one group. count_sum: over these, the number of rows that hold
    the pair of ids linked. n_best: those whose number no pair with the same id of A exceeds.

    Null and empty texts have no tokens, nor do texts that the tokens' bytes don't give back: zeros and no groups. A special
    token's string is text like any other. Rows with null or repeated doc_id come out as they are, and each counts as a
    document. Other columns are ignored. Without rows there are none.
    """
    spark, rows = docs.sparkSession, keyed(docs, id_col, text_col)
    table = pair_table(docs, path_a, path_b, id_col, text_col)
    size = table.agg(F.sum(sum(F.octet_length(c) for c in ("words", "keys", "counts", "best")))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([row.asDict() for row in table.collect()])
        made = rows.mapInArrow(_looked_up(path_a, path_b, sent, uuid.uuid4().hex, digest), _ROWS)
    else:
        links = _stored(rows.mapInArrow(_dealt_links(path_a, path_b, digest), _LINKS), "pair-links")
        salted = table.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        asked = links.where("share is not null").select("share", "salt", "uids", "pairs", "times")
        values = _first(salted, asked, by=["share", "salt"]).mapInArrow(_link_values, "uid long, n_best long, count_sum long")
        sums = values.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        made = links.where("share is null").drop("share", "salt", "uids", "pairs", "times").join(sums, "uid", "left").fillna(0, ["n_best", "count_sum"])
    return made.select(real_id(), *_NUMBERS, "groups")
