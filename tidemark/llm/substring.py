"""Removal of repeated passages: every window of `width` words whose sequence also starts earlier goes.

Windows are hashed by Rabin-Karp in two bases modulo 2**61 - 1, over words that XXH3 hashes to 128 bits: windows are equal
if both hashes are, which no pair of different ones among 10**15 is to be expected to fulfil by chance. To count them without shuffling one row for each word of the corpus, a
window is filed under its anchor, the smallest hash of its short word runs (`ANCHOR` words): equal windows
have equal anchors, and some eight neighbours share one, so

1. anchors are counted in Spark (a row for each run of windows under one anchor); a window whose anchor
   occurs once in the corpus occurs once itself;
2. the windows under repeated anchors are dealt by anchor, and in each group a window hash keeps its first
   start in the order of (doc_id, start); neighbouring repeats merge to maximal intervals;
3. the intervals meet the texts again.

Before either shuffle, repeats inside a slice of the input are settled on the spot and only the first goes
on. An anchor under which a third of all documents fall thus sends a row for each slice, not each document.
Under an anchor of more than `HOT` such rows each window is dealt by its own hash, so the anchor is split, and
equal windows still meet; their rows come in order, the first stays, and no task holds the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BASES, checkpointed, ints, keyed, looked_up, mixed, real_id, rolling, slices, texts_of, word_hashes, words_of

WIDTH, ANCHOR, HOT = 20, 4, 32
ANCHORS = "key long, anchor long, _id long, _tag long, known boolean"
#: hashes has two values for each window; of a settled run, its number of windows and 0. lane: a single window's second hash.
RUNS = "anchor long, lane long, _id long, _tag long, start int, hashes array<long>, settled boolean, single boolean"
SPANS = "_id long, _tag long, start int, stop int"
RESULT = "_id long, _tag long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the texts: its text's index, its start, its anchor and its two hashes."""
    words, others, counts = word_hashes(texts)
    short = min(ANCHOR, width)
    if len(words) < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    anchors = _sliding_min(mixed(rolling(words, short)), width - short + 1)
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), counts)[: len(anchors)]
    start = np.arange(len(anchors)) - first[text]
    whole = start + width <= counts[text]
    return text[whole], start[whole], anchors[whole], rolling(words, width)[whole], rolling(others, width, BASES[1])[whole]


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _equal_to_head(order: np.ndarray, keys: tuple[np.ndarray, ...], places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows stand, in that order, at the same place as the first row with their keys: repeated rows share a place."""
    head = _run_starts(*(k[order] for k in keys))
    leader = order[np.repeat(head, np.diff(np.append(head, len(order))))]
    out = np.zeros(len(order), bool)
    out[order] = np.logical_and.reduce([p[order] == p[leader] for p in places])
    return out


def _anchor_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            text, start, anchor, hashes, _ = _windows(texts_of(part, "_text"), width)
            if not len(text):
                continue
            at = _run_starts(text, anchor)
            run_anchor, run_text = anchor[at], text[at]
            order = np.argsort(run_anchor, kind="stable")
            run_anchor, run_text = run_anchor[order], run_text[order]
            head = _run_starts(run_anchor)
            size = np.diff(np.append(head, len(order)))
            known = np.repeat(size > 1, size)
            repeats = np.sort(hashes)
            repeats = repeats[1:][repeats[1:] == repeats[:-1]]
            if len(repeats):  # a window that recurs inside one run
                inner = np.unique(anchor[np.isin(hashes, repeats)])
                known |= np.isin(run_anchor, inner)
            keep = np.zeros(len(order), bool)
            keep[head] = True
            key = np.where(keep, run_anchor, mixed(run_anchor ^ mixed(run_text.astype(np.uint64) + ints(part, "_tag")[run_text].view(np.uint64))))
            one = keep | (np.append(True, (run_text[1:] != run_text[:-1]) | (run_anchor[1:] != run_anchor[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)[one]), pa.array(run_anchor.view(np.int64)[one]), pa.array(ints(part, "_id")[run_text][one]), pa.array(ints(part, "_tag")[run_text][one]), pa.array(known[one])],
                names=["key", "anchor", "_id", "_tag", "known"],
            )

    return rows


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values.view(np.int64)))


def _candidate_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            text, start, anchor, hashes, seconds = _windows(texts_of(part, "_text"), width)
            lists = part.column("anchors")
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            wanted = mixed(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + owner.astype(np.uint64))
            held = np.isin(mixed(anchor + text.astype(np.uint64)), wanted)
            text, start, anchor, hashes, seconds = text[held], start[held], anchor[held], hashes[held], seconds[held]
            if not len(text):
                continue
            single = np.isin(anchor, part.column("hot").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            ident, tag = ints(part, "_id")[text], ints(part, "_tag")[text]
            order = np.lexsort((start, tag, ident, seconds, hashes, anchor))
            first = _equal_to_head(order, (anchor, hashes, seconds), (ident, tag, start))
            broken = np.append(False, start[1:] != start[:-1] + 1)
            apart = np.cumsum(broken | (single & first))  # an open window of a hot anchor is a run of its own
            at = _run_starts(text, anchor, first, apart)
            run = lambda column: pa.array(column[at])
            stop = np.append(at[1:], len(text))
            counts = np.where(first[at], stop - at, 1)  # of a settled run its length is all that is needed
            takes = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            values = np.stack([hashes[takes], seconds[takes]], 1)
            ends = np.cumsum(counts)
            settled = ~first[at]
            values[(ends - 1)[settled]] = np.stack([(stop - at)[settled].astype(np.uint64), np.zeros(settled.sum(), np.uint64)], 1)
            own = np.where(single[at], mixed(hashes[at] + np.uint64(1)), anchor[at])
            key = np.where(settled, mixed(anchor[at] ^ mixed(ident[at].view(np.uint64) + start[at].astype(np.uint64))), own)
            alone = single[at] & ~settled
            lane = np.where(alone, seconds[at], np.uint64(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(lane), run(ident), run(tag), pa.array(start[at], pa.int32()), _lists(values.ravel(), 2 * (ends - counts)), pa.array(settled), pa.array(alone)],
                names=["anchor", "lane", "_id", "_tag", "start", "hashes", "settled", "single"],
            )

    return rows


def _spans_of(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Of rows in the order of anchor, _id, _tag and start: the words under windows that are not the first of their hash."""
    settled = batch.column("settled").to_numpy(zero_copy_only=False)
    lists = batch.column("hashes")
    counts = lists.value_lengths().to_numpy() // 2
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    ends = np.cumsum(counts)
    ident, tag, start, anchor = (ints(batch, c) for c in ("_id", "_tag", "start", "anchor"))
    done = np.flatnonzero(settled)
    row = np.repeat(np.arange(batch.num_rows), counts)
    open_ = ~settled[row]
    row, within, (hashes, seconds) = row[open_], (np.arange(len(values)) - np.repeat(ends - counts, counts))[open_], values[open_].T
    place = ident[row], tag[row], start[row] + within
    order = np.lexsort((*place[::-1], seconds, hashes, anchor[row]))
    later = ~_equal_to_head(order, (anchor[row], hashes, seconds), place)
    row, within = row[later], within[later]
    at = _run_starts(row, within - np.arange(len(row)))
    length = np.diff(np.append(at, len(row)))
    rows = np.concatenate([row[at], done])
    begin = np.concatenate([start[row[at]] + within[at], start[done]])
    length = np.concatenate([length, values[(ends - 1)[done], 0]])
    return pa.RecordBatch.from_arrays(
        [pa.array(ident[rows]), pa.array(tag[rows]), pa.array(begin, pa.int32()), pa.array(begin + length + width - 1, pa.int32())],
        names=["_id", "_tag", "start", "stop"],
    )


def _single_spans(batch: pa.RecordBatch, width: int, last: tuple[int, ...]) -> tuple[pa.RecordBatch, tuple[int, ...]]:
    """The spans of windows dealt by their hash, in order, that are not at the place of their hashes' first; last: hashes and first place of the row before."""
    key, lane = ints(batch, "anchor"), ints(batch, "lane")
    columns = key, lane, ints(batch, "_id"), ints(batch, "_tag"), ints(batch, "start")
    head = _run_starts(key, lane)
    leader = [np.repeat(c[head], np.diff(np.append(head, len(key)))) for c in columns]
    if last and last[:2] == (key[0], lane[0]):
        for c, x in zip(leader, last, strict=True):
            c[: head[1] if len(head) > 1 else len(key)] = x
    later = ~np.logical_and.reduce([x == y for x, y in zip(columns[2:], leader[2:], strict=True)])
    _, _, ident, tag, start = (c[later] for c in columns)
    spans = [pa.array(ident), pa.array(tag), pa.array(start, pa.int32()), pa.array(start + width, pa.int32())]
    return pa.RecordBatch.from_arrays(spans, names=["_id", "_tag", "start", "stop"]), tuple(int(c[-1]) for c in leader)


def _span_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # rows of the anchor that the next batch may continue, HOT at most
        last: tuple[int, ...] = ()
        for whole in batches:
            single = whole.column("single")
            alone, batch = whole.filter(single), whole.filter(pc.invert(single))
            if alone.num_rows:
                spans, last = _single_spans(alone, width, last)
                yield spans
            if not batch.num_rows:
                continue
            anchor = ints(batch, "anchor")
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                done = pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()
                yield from (_spans_of(b, width) for b in done)
                rest = []
            elif rest and ints(rest[-1], "anchor")[-1] != anchor[0]:
                yield from (_spans_of(b, width) for b in pa.Table.from_batches(rest).combine_chunks().to_batches())
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from (_spans_of(b, width) for b in pa.Table.from_batches(rest).combine_chunks().to_batches())

    return rows


def _merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """The number of words, and those outside the spans (in order, apart) with one space between, in one pass."""
    n, kept, k = 0, [], 0
    for words in words_of(text):
        at, end = n, n + len(words)
        while at < end:
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            a, b = spans[k] if k < len(spans) else (end, end)
            if at < a:
                kept.append(b" ".join(words[at - n : min(a, end) - n]))
            at = max(at, min(b, end)) if a < end else end
        n = end
    return n, b" ".join(kept)


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        n_words, n_removed, kept, spans = [], [], [], []
        for text, found in zip(texts_of(part, "_text"), part.column("found").to_pylist(), strict=True):
            merged = _merged([x["start"] for x in found], [x["stop"] for x in found]) if found else []
            n, rest = _without(text, merged)
            n_words.append(n)
            n_removed.append(sum(b - a for a, b in merged))
            kept.append(rest.decode())
            spans.append([{"start": a, "stop": b} for a, b in merged])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [part.column("_id"), part.column("_tag"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)],
            names=["_id", "_tag", "n_words", "n_removed", "kept", "spans"],
        )


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, one space between) and spans (word ranges removed).

    A null or empty text has no words. A null doc_id counts as the largest. Rows that share a doc_id are
    ordered by a hash of their texts; rows equal in both count as one row and each comes out. Texts shorter
    than a window stay whole. Other columns are ignored, whatever their names.
    """
    texts = keyed(docs, id_col, text_col)
    counted = texts.mapInArrow(_anchor_rows(width), ANCHORS).repartition("key").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    rows = checkpointed(counted.where("n > 1 or known").select("anchor", "_id", "_tag", (F.col("key") == F.col("anchor")).alias("counts"), "n"))
    heads = rows.where("counts").withColumn("hot", F.when(F.col("n") > HOT, F.col("anchor")))
    hot = heads.where("hot is not null").select("anchor", "hot").distinct()
    others = looked_up(rows.where("not counts"), ["anchor"], hot, how="left")
    repeated = heads.unionByName(others).groupBy("_id", "_tag").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("hot").alias("hot"))
    candidates = texts.join(repeated, ["_id", "_tag"]).mapInArrow(_candidate_rows(width), RUNS)
    spans = candidates.repartition("anchor").sortWithinPartitions("anchor", "lane", "_id", "_tag", "start").mapInArrow(_span_rows(width), SPANS)
    found = spans.groupBy("_id", "_tag").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    result = texts.join(found, ["_id", "_tag"], "left").mapInArrow(_kept_rows, RESULT)
    return result.select(real_id(), "n_words", "n_removed", "kept", "spans")

