"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on the document ids.

Files are written in ascending doc_id order, a range of ids in each, so a lookup prunes files and stripes by
their statistics and row groups by the Bloom filter, and stripes are read in parallel. Each row holds its
offset in the range of ids that its task wrote, to one file or several; the position in the whole corpus is the
distance to its file's first row plus the totals of the files before, which the n_tokens column gives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe import codec
from tidemark.llm.common import keyed, real_id, slices, texts_of

STRIPE_BYTES, ROW_GROUP = 64 << 20, 1000
ROWS = "_id long, _tag long, task_offset long, n_tokens long, ids array<int>"


def _token_rows(path: str, end_id: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, offset = codec(path), 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "_text"):
            raw = [r + end for r in c.encode([t.decode() for t in texts_of(part, "_text")], c.library_pieces)]
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_tag"), pa.array(offset + ends[:-1]), pa.array(np.diff(ends)), ids], names=["_id", "_tag", "task_offset", "n_tokens", "ids"])
            offset += int(ends[-1])

    return rows


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text with the tokenizers library (pieces it has met before come from a memo) and writes ORC.

    A null text is empty: its row holds the end id alone. A null doc_id comes last, and stays null in the file.
    Rows that share a doc_id follow each other in the order of a hash of their texts. Other columns are not written.
    """
    ordered = keyed(docs, id_col, text_col).repartitionByRange("_id", "_tag").sortWithinPartitions("_id", "_tag")
    tokens = ordered.mapInArrow(_token_rows(path, end_id), ROWS).select(real_id(), F.col("_tag").alias("row_tag"), "task_offset", "n_tokens", "ids")
    writer = tokens.write.mode("errorifexists").option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.row.index.stride", str(ROW_GROUP)).option("orc.stripe.size", str(STRIPE_BYTES)).orc(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows, with the file that each is in."""
    schema = "doc_id long, row_tag long, task_offset long, n_tokens long, ids array<int>"
    return spark.read.schema(schema).orc(out).select("*", F.col("_metadata.file_path").alias("file"))


def with_starts(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Adds start, the number of ids in all documents before; all_rows: read_tokens of the whole corpus."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_tag")
    files = all_rows.groupBy("file").agg(F.min(place).alias("first"), F.min("task_offset").alias("base"), F.sum("n_tokens").alias("total"))
    # one row for each file of the corpus; files that begin with equal rows are of one task
    before = F.coalesce(F.sum("total").over(Window.orderBy("first", "base").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files.select("file", (before - F.col("base")).alias("_before")), "file").withColumn("start", F.col("_before") + F.col("task_offset")).drop("_before")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, row_tag, file, task_offset, n_tokens (counted from the ids) and ids_crc32 of rows of read_tokens."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4").tobytes())
            ends = (4 * np.cumsum(sizes)).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row_tag", "file", "task_offset")), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "row_tag", "file", "task_offset", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(made, "doc_id long, row_tag long, file string, task_offset long, n_tokens long, ids_crc32 long")
