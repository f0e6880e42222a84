"""Line dedup: hashes in ranges, sorted by document and position; the first document of each keeps its lines.

Each slice of the input settles the lines that repeat inside it: of a line's documents in the slice only the
smallest can be the first of all, so only its row is dealt by hash, and the others' lines are known to go. A
line that a third of all documents share thus sends one row a slice. Hashes are uniform, so equal ranges of
them (`repartitionById`) are even partitions and need no sampling pass. Each partition is streamed in
the order of hash, document and position, and what comes out are the positions to drop, packed into a
zlib-compressed bitmap for each document, without its text. Who wants the kept lines joins the bitmaps to the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import docs_key, ints, keyed, mixed, real_id, slices, texts_of

LEAST = 10
LINES = "hi long, lo long, _id long, _tag long, pos int, settled boolean"
DROPS = "_id long, _tag long, pos int"
BITMAPS = "_id long, _tag long, n_lines long, n_dropped long, bitmap binary"


def _key(line: bytes, least: int) -> bytes | None:
    key = line.strip().lower()  # bytes.strip() takes 20 and 09-0D, lower() A-Z only
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


def _line_rows(least: int):
    """A row for each line that may repeat, and a settled one for each document, whose pos is -1 less its lines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_128_digest
        for part in slices(batches, "_text"):
            digests, owner, pos, counts = [], [], [], []
            for k, text in enumerate(texts_of(part, "_text")):
                lines = text.split(b"\n")
                counts.append(len(lines))
                for p, line in enumerate(lines):
                    if (key := _key(line, least)) is not None:
                        digests.append(h(key))
                        owner.append(k)
                        pos.append(p)
            ids, tags = ints(part, "_id"), ints(part, "_tag")
            ahead = mixed(ids.view(np.uint64) ^ mixed(tags.view(np.uint64)))
            names = ["hi", "lo", "_id", "_tag", "pos", "settled"]
            yield pa.RecordBatch.from_arrays([pa.array(ahead.view(np.int64)), *(pa.array(x) for x in (tags, ids, tags)), pa.array(-1 - np.array(counts), pa.int32()), pa.array(np.ones(len(ids), bool))], names=names)
            if not digests:
                continue
            both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
            hi, lo, owner, pos = both[:, 0].copy(), both[:, 1].copy(), np.array(owner), np.array(pos, np.int32)
            ident, tag = ints(part, "_id")[owner], ints(part, "_tag")[owner]
            order = np.lexsort((pos, tag, ident, lo, hi))
            hi, lo, ident, tag, pos = (x[order] for x in (hi, lo, ident, tag, pos))
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            head = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(hi))))
            settled = ident != ident[head]  # a smaller document of this slice has the line
            place = mixed(ident.view(np.uint64) ^ mixed(tag.view(np.uint64) + pos.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(settled, place, hi).view(np.int64)), pa.array(lo.view(np.int64)), pa.array(ident), pa.array(tag), pa.array(pos), pa.array(settled)],
                names=names,
            )

    return rows


def _drop_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of hi, lo, _id: settled ones, and those of documents after the first of their hash."""
    last: tuple[int, int, int] | None = None  # the hash that the batch before ended with, and its first document
    for batch in batches:
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        hi, lo, ident = (ints(batch, c) for c in ("hi", "lo", "_id"))
        drop = settled.copy()
        open_ = np.flatnonzero(~settled)
        if len(open_):
            h, low, doc = hi[open_], lo[open_], ident[open_]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
            starts = np.flatnonzero(new)
            first = np.repeat(doc[starts], np.diff(np.append(starts, len(h))))
            if last is not None and (h[0], low[0]) == last[:2]:
                first[: starts[1] if len(starts) > 1 else len(h)] = last[2]
            drop[open_] = doc != first
            last = int(h[-1]), int(low[-1]), int(first[-1])
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(drop)) for c in ("_id", "_tag", "pos")], names=["_id", "_tag", "pos"])


def packed(n_lines: int, drops: list[int] | None) -> bytes:
    """A keep bitmap, bit k of the row for line k, compressed."""
    keep = np.ones(n_lines, bool)
    keep[drops or []] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines].astype(bool)


def _bitmap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped, made = [], [], []
        for marks in batch.column("marks").to_pylist():
            lines = -1 - min(marks)
            drops = [p for p in marks if p >= 0]
            n.append(lines)
            dropped.append(len(drops))
            made.append(packed(lines, drops))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_tag"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(made, pa.binary())], names=["_id", "_tag", "n_lines", "n_dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """_id, _tag, doc_id, n_lines, n_dropped and bitmap (see packed) for each different doc_id and text.

    Lines are what `\\n` separates; a null or empty text is one empty line. A line's key is the line without
    white space at both ends, in lower case (A-Z); keys of `least` code points or more that two documents hold
    are kept in the smallest doc_id alone, there each time. Rows that share a doc_id are one document; a null
    doc_id is the largest. Rows equal in doc_id and text have one bitmap. Other columns are ignored.
    """
    lines = keyed(docs, id_col, text_col).mapInArrow(_line_rows(least), LINES)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.shiftright(F.shiftrightunsigned("hi", 33) * n, 31).cast("int")  # the top 31 bits, times n, over 2**31
    ranged = lines.repartitionById(n, bucket).sortWithinPartitions("hi", "lo", "_id", "_tag", "pos")
    marks = ranged.mapInArrow(_drop_rows, DROPS).groupBy("_id", "_tag").agg(F.collect_set("pos").alias("marks"))
    return marks.mapInArrow(_bitmap_rows, BITMAPS).select("_id", "_tag", real_id(), "n_lines", "n_dropped", "bitmap")


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        kept = []
        for text, bitmap, n, dropped in zip(texts_of(part, "_text"), part.column("bitmap").to_pylist(), part.column("n_lines").to_pylist(), part.column("n_dropped").to_pylist(), strict=True):
            if dropped:
                text = b"\n".join(compress(text.split(b"\n"), unpacked(bitmap, n).tolist()))
            kept.append(text.decode())
        rest = [c for c in part.schema.names if c != "_text"]
        none = part.column("_text").is_null().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(kept, pa.string(), mask=none)], names=[*rest, "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _tag, n_lines, n_dropped, bitmap, row (the columns of docs but its text) and kept, the kept lines joined by `\\n`, for each row of docs.

    bitmaps: keep_bitmaps of docs. Lines are dropped in one pass over their positions. A null text stays null.
    """
    row = F.struct(*(docs[c] for c in docs.columns if c != text_col))
    own = docs.select(row.alias("row"), *docs_key(docs, id_col, text_col), docs[text_col].alias("_text"))
    joined = own.join(bitmaps.select("_id", "_tag", "n_lines", "n_dropped", "bitmap"), ["_id", "_tag"])
    kinds = T.StructType([f for f in joined.schema.fields if f.name != "_text"]).add("kept", "string")
    return joined.mapInArrow(_kept_rows, kinds)
