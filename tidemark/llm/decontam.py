"""Benchmark decontamination by q-gram filtering in diagonal bands and banded alignment.

Benchmark items are cut into segments of `SEGMENT` characters that overlap by half. A document holds a segment
if some region is within `RATE` of the segment's length in edits. By the q-gram lemma such a region shares at
least (number of grams) - q * edits of any chosen set of the segment's grams, on diagonals that spread over
no more than the edits; hits are therefore counted in bands of diagonals, twice as wide as the edit budget plus
one and overlapping by half. Bands that reach the bound are verified by an alignment confined to the band. The
grams chosen are those that are rare in the benchmark, as long as their bound stays useful.

Items too short for that (under 2q characters) are looked for as they are, between characters that are neither
letters nor digits. Texts over `CHUNK` characters are searched piece by piece, the pieces overlapping by more than
any region.

The benchmark is the query set: it is taken in blocks of `BLOCK_CHARS`, each sent to the tasks by itself; the
documents are read once for each block and never shuffled. With several blocks each block's matches are written
before the next index is made, so the driver holds one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carried, keyed, mixed, new_path, real_id, slices, texts_of

Q, SEGMENT, RATE, COMMON, LEAST_BOUND = 8, 120, 0.08, 3, 8
BLOCK_CHARS, CHUNK, OVERLAP = 1 << 22, 1 << 20, 1 << 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS, _COUNT_BITS = 21, 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _chunks(text: str, size: int = CHUNK) -> Iterator[tuple[int, str]]:
    """The normalised text in pieces that overlap by OVERLAP characters, and where each begins in it."""
    if len(text) <= size:
        yield 0, normal(text)
        return
    at, offset, held, gap = 0, 0, "", False
    while at < len(text):
        to = min(len(text), at + size)
        cut = to
        while to < len(text) and cut > at and not text[cut - 1].isspace():
            cut -= 1
        to = cut if cut > at else to
        new = normal(text[at:to])
        gap |= text[at].isspace()
        if new:
            tail = held[-OVERLAP:]
            offset += len(held) - len(tail)
            held = tail + (" " if tail and gap else "") + new
            yield offset, held
            gap = False
        gap |= text[to - 1].isspace()
        at = to


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    n = len(codes) - q + 1
    h = codes[:n].astype(np.uint64)
    for k in range(1, q):
        h *= _BASE
        h += codes[k : k + n]
    return mixed(h)


def _edits(length: int) -> int:
    return int(RATE * length)


@dataclass
class Index:
    """Segments of one block of the benchmark and where their grams are."""

    item: list[int | None]  # of each segment
    codes: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray  # sorted
    segment: np.ndarray  # of each gram
    place: np.ndarray  # in its segment
    table: np.ndarray  # which leading bits some gram has
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: the sorted hashes of short items, and their segments


def build_index(items: list[tuple[int | None, str]], q: int = Q, segment: int = SEGMENT) -> Index:
    owner: list[int | None] = []
    codes: list[np.ndarray] = []
    own_grams: list[np.ndarray] = []  # of each item, once each
    brief: dict[int, list[tuple[int, int]]] = {}
    long: list[int] = []  # segments of items that are not short
    for item, text in items:
        whole = _codes(normal(text))
        if len(whole) < 2 * q:
            if len(whole):
                brief.setdefault(len(whole), []).append((int(_grams(whole, len(whole))[0]), len(owner)))
                owner.append(item)
                codes.append(whole)
            continue
        own_grams.append(np.unique(_grams(whole, q)))
        last = max(0, len(whole) - segment)
        for at in dict.fromkeys([*range(0, last, segment // 2), last]):
            long.append(len(owner))
            owner.append(item)
            codes.append(whole[at : at + segment])
    short = {}
    for size, found in brief.items():
        h, k = (np.array(x) for x in zip(*sorted(found), strict=True))
        short[size] = h.astype(np.uint64), k
    edits = np.array([_edits(len(c)) if len(c) >= 2 * q else 0 for c in codes], np.int64)
    bound = np.full(len(codes), 1 << 40)  # short items have no bound
    table = np.zeros(1 << _TABLE_BITS, bool)
    if not long:
        empty = np.zeros(0, np.int32)
        return Index(owner, codes, edits, bound, np.zeros(0, np.uint64), empty, empty, table, short)
    # in how many items a gram occurs
    known, frequency = np.unique(np.concatenate(own_grams), return_counts=True)
    gram, seg, place = [], [], []
    for k in long:
        g = _grams(codes[k], q)
        rare = frequency[np.searchsorted(known, g)] <= COMMON
        if rare.sum() - q * edits[k] < LEAST_BOUND:
            rare[:] = True
        bound[k] = max(1, int(rare.sum()) - q * int(edits[k]))
        gram.append(g[rare])
        seg.append(np.full(int(rare.sum()), k, np.int32))
        place.append(np.flatnonzero(rare).astype(np.int32))
    gram, seg, place = map(np.concatenate, (gram, seg, place))
    order = np.argsort(gram, kind="stable")
    table[gram >> np.uint64(64 - _TABLE_BITS)] = True
    return Index(owner, codes, edits, bound, gram[order], seg[order], place[order], table, short)


def banded_distances(patterns: list[np.ndarray], text: np.ndarray, begin: np.ndarray, stop: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern: the fewest edits that turn it into some substring of text[begin:stop] on `width` diagonals
    (text minus pattern position) from low on, and where that substring ends. All patterns advance together."""
    size = np.array([len(p) for p in patterns])
    padded = np.zeros((int(size.max()), len(patterns)), np.uint32)
    for k, p in enumerate(patterns):
        padded[: len(p), k] = p
    big = np.int32(1 << 28)
    ramp = np.arange(int(width.max()), dtype=np.int32)
    at = low[:, None] + ramp  # the text character that a match on each diagonal takes
    first, last = begin[:, None], stop[:, None]
    off = ramp >= width[:, None]
    cost = np.where(off | (at < first) | (at > last), big, np.int32(0))
    edits, end = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    up = np.empty_like(cost)
    for i, row in enumerate(padded):
        inside = (at >= first) & (at < last)
        step = np.where(inside, (text[np.clip(at, 0, len(text) - 1)] != row[:, None]).astype(np.int32), big)
        up[:, :-1], up[:, -1] = cost[:, 1:] + 1, big
        new = np.minimum(cost + step, up)  # match or replace; drop a pattern character
        at += 1
        new[off | (at < first) | (at > last)] = big
        cost = np.minimum(np.minimum.accumulate(new - ramp, axis=1) + ramp, big)  # skip text characters
        done = np.flatnonzero(size == i + 1)
        if len(done):
            best = cost[done].argmin(axis=1)
            edits[done], end[done] = cost[done, best], at[done, best]
    return edits, end


def _short_matches(index: Index, joined: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """The first place of each short item in each text, found whole and between no letters or digits."""
    loose = lambda at: not 0 <= at < len(joined) or not chr(joined[at]).isalnum()
    for size, (hashes, segments) in index.short.items():
        h = _grams(joined, size)
        left = np.searchsorted(hashes, h, "left")
        count = np.searchsorted(hashes, h, "right") - left
        met: set[tuple[int, int]] = set()
        for at in np.flatnonzero(count).tolist():
            doc = int(np.searchsorted(bounds, at, "right")) - 1
            if at + size < bounds[doc + 1] and loose(at - 1) and loose(at + size):
                for s in segments[left[at] : left[at] + count[at]].tolist():
                    if (doc, s) not in met and (joined[at : at + size] == index.codes[s]).all():
                        met.add((doc, s))
                        yield doc, s, 0, at - int(bounds[doc]), at - int(bounds[doc]) + size


def _found(index: Index, texts: list[str], q: int) -> Iterator[tuple[int, int, int, int, int]]:
    """text's number, segment, edits, start of the region, end, in the normalised texts; each segment's best region."""
    whole: list[int] = []
    for k, text in enumerate(texts):
        if len(text) <= CHUNK:
            whole.append(k)
            continue
        best: dict[int, tuple[int, int, int]] = {}
        for offset, piece in _chunks(text):
            for _, s, edits, start, stop in _matches(index, [piece], q):
                best[s] = min(best.get(s, (1 << 28, 0, 0)), (edits, start + offset, stop + offset))
        for s, found in best.items():
            yield k, s, *found
    for k, *found in _matches(index, [normal(texts[k]) for k in whole], q) if whole else ():
        yield whole[k], *found


def _matches(index: Index, texts: list[str], q: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The same of normalised texts that one numpy step can take."""
    joined = _codes("\n".join(texts))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    yield from _short_matches(index, joined, bounds)
    if not len(index.gram):
        return
    h = _grams(joined, q)
    at = np.flatnonzero(index.table[h >> np.uint64(64 - _TABLE_BITS)])
    left = np.searchsorted(index.gram, h[at], "left")
    count = np.searchsorted(index.gram, h[at], "right") - left
    at, left, count = at[count > 0], left[count > 0], count[count > 0]
    hit = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
    seg, diagonal = index.segment[hit].astype(np.int64), np.repeat(at, count) - index.place[hit]
    stride = index.edits[seg] + 1
    band = diagonal // stride
    offset = int(bounds[-1]) + 2
    keys = np.concatenate([seg * (2 * offset) + band + offset, seg * (2 * offset) + band - 1 + offset])
    if len(keys):  # counts by a hash of the key are no smaller than the key's own
        slot = (keys.astype(np.uint64) * _BASE >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)
        keys = keys[np.bincount(slot, minlength=1 << _COUNT_BITS)[slot] >= index.bound.min()]
    keys, hits = np.unique(keys, return_counts=True)
    seg, band = keys // (2 * offset), keys % (2 * offset) - offset
    full = hits >= index.bound[seg]
    seg, band = seg[full], band[full]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for part in range(0, len(seg), 256):
        tried, patterns = [], []
        for s, b in zip(seg[part : part + 256].tolist(), band[part : part + 256].tolist(), strict=True):
            e, size = int(index.edits[s]), len(index.codes[s])
            low, high = b * (e + 1) - e, b * (e + 1) + 3 * e + 1
            doc = int(np.searchsorted(bounds, max(0, (low + high + size) // 2), "right")) - 1
            for d in range(max(0, doc - 1), min(len(texts), doc + 2)):  # a band may reach into a neighbour
                if high + size >= bounds[d] and low < bounds[d + 1]:
                    tried.append((d, s, bounds[d], bounds[d + 1] - 1, low, high - low + 1))
                    patterns.append(index.codes[s])
        if not tried:
            continue
        found = banded_distances(patterns, joined, *np.array(tried)[:, 2:].T)
        for (d, s, begin, *_), edits, end in zip(tried, *(x.tolist() for x in found), strict=True):
            if edits <= min(int(index.edits[s]), best.get((d, s), (1 << 28,))[0] - 1):
                stop = end - int(begin)
                best[d, s] = edits, max(0, stop - len(index.codes[s])), stop
    for (d, s), found in best.items():
        yield d, s, *found


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, q: int) -> Iterator[Index]:
    """An index of each block of the benchmark."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("long"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield build_index(block, q)
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield build_index(block, q)


def _met(docs: DataFrame, indexes: Iterator[Index], id_col: str, text_col: str, q: int) -> DataFrame:
    """A row for each segment that a document holds."""
    schema = "_id long, _tag long, item_id long, segment long, edits int, start int, stop int"

    def finder(index: Index, block: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "_text"):
                found = list(_found(index, [t.decode() for t in texts_of(part, "_text")], q))
                if not found:
                    continue
                doc, seg, edits, start, stop = zip(*found, strict=True)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(at), part.column("_tag").take(at), pa.array([index.item[s] for s in seg], pa.int64()), pa.array([(block << 32) + s for s in seg], pa.int64()), *(pa.array(x, pa.int32()) for x in (edits, start, stop))],
                    names=["_id", "_tag", "item_id", "segment", "edits", "start", "stop"],
                )

        return rows

    texts = keyed(docs, id_col, text_col)
    first = texts.mapInArrow(finder(next(indexes), 0), schema)
    out = None
    for block, index in enumerate(indexes, 1):
        if out is None:
            out = new_path(docs.sparkSession, "matches")
            first.write.parquet(out)
        texts.mapInArrow(finder(index, block), schema).write.mode("append").parquet(out)
    return first if out is None else docs.sparkSession.read.schema(schema).parquet(out)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q) -> DataFrame:
    """doc_id, item_id, n_segments, edits, start and stop (characters of the normalised text) for each document and item that meet.

    A document that holds no item has no row. Texts are compared in lower case with single spaces. Null texts
    hold nothing, null and blank items are in no document. Items of fewer than 2q characters are found exactly, as
    whole words. Rows with a null doc_id come out with null, repeated rows as one, items of null item_id as one
    item of null. Other columns are ignored.
    """
    met = _met(docs, _indexes(benchmark, item_col, item_text, q), id_col, text_col, q)
    best = met.groupBy("_id", "_tag", "item_id").agg(F.count_distinct("segment").cast("int").alias("n_segments"), F.min(F.struct("edits", "start", "stop")).alias("b"))
    return best.select(real_id(), "item_id", "n_segments", "b.edits", "b.start", "b.stop")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; null texts hold none.

    Rows are judged where they are read, without a shuffle, if the benchmark is one block; else those that any
    block met are left out by (doc_id, hash of the text).
    """
    indexes = _indexes(benchmark, item_col, item_text, q)
    index, more = next(indexes), next(indexes, None)
    if more is not None:
        met = _met(docs, chain([index, more], indexes), id_col, text_col, q).select(F.col("_id").alias("_met_id"), F.col("_tag").alias("_met_tag")).distinct()
        return carried(docs, id_col, text_col).join(met, (F.col("_id") == F.col("_met_id")) & (F.col("_tag") == F.col("_met_tag")), "left_anti").select("row.*")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            keep = np.ones(part.num_rows, bool)
            keep[[m[0] for m in _found(index, [t.decode() for t in texts_of(part, text_col)], q)]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)


def count_hits(texts: list[str], index: Index, q: int = Q) -> int:
    """How many gram hits the filter would expand for these texts, to choose q and COMMON by."""
    h = _grams(_codes("\n".join(map(normal, texts))), q)
    return int((np.searchsorted(index.gram, h, "right") - np.searchsorted(index.gram, h, "left")).sum())
