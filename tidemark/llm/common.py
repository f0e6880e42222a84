"""What the text operators share: row keys, Arrow slices, the shared folder, word hashes.

Every operator keys its rows by `_id` and `_tag` (see `keyed`): rows that share a doc_id but not a text
stay apart, and a null doc_id sorts after every other id instead of vanishing in a join.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = 2**63 - 1
#: Bytes of text that one numpy step works on; temporaries are some 60 times as large.
STEP_BYTES = 2 << 20
SPACE = rb"[\x20\x09-\x0D]"
_SPACES = re.compile(SPACE)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that a lost executor costs no recomputation of what is below."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Has the driver drop what is out of reach, so that Spark's cleaner deletes its shuffle files; for loops that shuffle many times."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def docs_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    ident = docs[id_col].cast("long")
    return [F.coalesce(ident, F.lit(LAST_ID)).alias("_id"), F.xxhash64(docs[text_col], ident.isNull()).alias("_tag")]


def keyed(docs: DataFrame, id_col: str, text_col: str, *, keep_text: bool = True) -> DataFrame:
    """`_id`, `_tag` and the text, with null texts as empty ones."""
    return docs.select(*docs_key(docs, id_col, text_col), *([F.coalesce(docs[text_col], F.lit("")).alias("_text")] if keep_text else []))


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`_id`, `_tag` and row, all columns of docs in one, so that none of their names clashes with ours."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(docs_key(docs, id_col, text_col)))


def real_id(name: str = "doc_id") -> Column:
    """The caller's doc_id from `_id`. An id of 2**63 - 1 stands for null and comes out as null."""
    return F.when(F.col("_id") != LAST_ID, F.col("_id")).alias(name)


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, how: str = "inner", salts: int = 32) -> DataFrame:
    """rows with the columns of table, which has one row for each value of keys; rows without one are left out, or have nulls if how is left.

    A key may hold any share of the rows: they are dealt by key and a salt, a hash of the whole row, and the
    table's row goes to the salts that occur. Only rows equal in all columns stay together.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    spread = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def slices(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `step` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    return pc.fill_null(batch.column(column).cast(kind), b"").to_pylist()


def ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


BYTE_BASE = 0x9E3779B97F4A7C15
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    size = 1 << max(16, (n - 1).bit_length())
    if (base, size) not in _tables:
        for old in [k for k in _tables if k[0] == base]:
            del _tables[old]
        _tables[base, size] = _powers(base, size), _powers(_inverse(base), size)
    return _tables[base, size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PRIME = np.uint64(2**61 - 1)
#: Bases of the two window hashes.
BASES = 0x1A5F3D86B1C94E27, 0x0E7D15A2C36B9F43
_LOW31, _LOW30 = np.uint64(2**31 - 1), np.uint64(2**30 - 1)
_U1, _U30, _U31, _U61 = (np.uint64(n) for n in (1, 30, 31, 61))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> _U61)
    return np.where(x >= PRIME, x - PRIME, x)


def times(x: np.ndarray, factor: int) -> np.ndarray:
    """x times a factor modulo 2**61 - 1; both are under it. Halves of 31 and 30 bits keep every product within 64 bits."""
    high, low = np.uint64(factor >> 31), np.uint64(factor & (2**31 - 1))
    x_high, x_low = x >> _U31, x & _LOW31
    middle = x_high * low + x_low * high
    return reduced(((x_high * high) << _U1) + (middle >> _U30) + ((middle & _LOW30) << _U31) + x_low * low)


def rolling(values: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes of all `width` consecutive values: polynomials in the base modulo the prime 2**61 - 1.

    They are joined from those of half the width, so log2(width) products are taken.
    """
    if len(values) < width:
        return np.zeros(0, np.uint64)
    p, done, out, span, have = 2**61 - 1, 0, None, values, 1  # out: of the `done` first values; span: of `have` values
    while True:
        if width & have:
            out = span if out is None else reduced(times(out[: len(out) - have], pow(base, have, p)) + span[done : done + len(out) - have])
            done += have
        if done == width:
            return out
        span, have = reduced(times(span[:-have], pow(base, have, p)) + span[have:]), 2 * have


def words_of(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, of some `size` bytes at a time."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > size and (found := _SPACES.search(text, at + size)):
            to = found.start()
        yield text[at:to].split()  # bytes.split() knows exactly 20 and 09-0D
        at = to


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes modulo 2**61 - 1 of each word (the halves of its XXH3-128), one text after the other, and each text's number of words."""
    out: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for words in words_of(text):
            out.append(b"".join(map(xxhash.xxh3_128_digest, words)))
            counts[k] += len(words)
    halves = np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)
    return reduced(halves[:, 0]), reduced(halves[:, 1]), counts


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, for buckets of features; words made to collide do."""
    power, inverse = _table(BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
