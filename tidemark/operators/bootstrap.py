"""Resampling by counters: every weight is a hash of (seed, replicate, row or draw), so runs and retries agree.

Rows are never multiplied by replicates. A task adds up all replicates of its rows in arrays, by slices of replicates
that fit in memory, and the tasks' arrays are summed in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GOLD = 0x9E3779B97F4A7C15
#: Weights (rows times replicates) that a task makes at a time.
CELLS = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counters(seed: int, replicates: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each replicate (rows) and key (columns)."""
    of_rep = mixed(replicates.astype(np.uint64) * np.uint64(_GOLD) + np.uint64((seed * 0xD1342543DE82EF95 + 1) % 2**64))
    return mixed(of_rep[:, None] + mixed(keys.astype(np.uint64))[None, :])


def block_draws(n: int, replicates: int, seed: int) -> Iterator[np.ndarray]:
    """The blocks that replicates draw with replacement, n of n each: arrays of some replicates (rows) and their draws, in order."""
    step = max(1, CELLS // n)
    for first in range(0, replicates, step):
        yield (counters(seed, np.arange(first, min(replicates, first + step)), np.arange(n)) % np.uint64(n)).astype(np.int64)


def _thresholds() -> np.ndarray:
    """Of 64-bit values, the least that gets a weight of 1, 2, ... under a Poisson law of mean 1."""
    total, out = 0.0, []
    for k in range(20):
        total += exp(-1) / factorial(k)
        out.append(min(2**64 - 1, int(total * 2**64)))
    return np.array(out, np.uint64)


_BOUNDS = _thresholds()
#: The weight of the least value with each upper 16 bits, and those upper bits that hold more than one weight.
_TABLE = np.searchsorted(_BOUNDS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48), side="right").astype(np.int8)
_MIXED = np.zeros(1 << 16, bool)
_MIXED[(_BOUNDS >> np.uint64(48)).astype(np.int64)] = True


def poisson_weights(hashes: np.ndarray) -> np.ndarray:
    """Poisson weights of mean 1 by inversion: a table of the upper bits, and a search where these don't decide."""
    upper = (hashes >> np.uint64(48)).astype(np.int64)
    out = _TABLE[upper]
    unsure = _MIXED[upper]
    out[unsure] = np.searchsorted(_BOUNDS, hashes[unsure], side="right")
    return out


def poisson_sums(rows: DataFrame, key: list[str], values: dict[str, Column], by: list[str] | None = None, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """by, rep and the sums of values over all rows of a group, each row weighed by its own Poisson count in that replicate.

    key: what names a row; rows equal in it are drawn together, so a block's name draws blocks. One pass over the
    rows, which may be any number; a task holds the replicates' sums of the groups that it has seen, and what is
    shuffled is one row for each task, group and slice of replicates. A null value counts as zero.
    """
    by = by or []
    names = list(values)
    made = rows.select(*by, F.xxhash64(*key).alias("_key"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in values.items()))
    kinds = dict(made.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            groups = pdf.groupby(by, dropna=False, sort=False).indices.items() if by else [((), np.arange(len(pdf)))]
            for g, at in groups:
                g = g if isinstance(g, tuple) else (g,)
                g = tuple(None if pd.isna(x) else x for x in g)
                total = sums.setdefault(g, np.zeros((replicates, len(names))))
                keys = pdf["_key"].to_numpy(np.int64)[at].view(np.uint64)
                x = pdf[names].to_numpy(float)[at]
                step = max(1, CELLS // max(1, len(at)))
                for first in range(0, replicates, step):
                    reps = np.arange(first, min(replicates, first + step))
                    total[reps] += poisson_weights(counters(seed, reps, keys)) @ x
        for g, total in sums.items():
            columns = [pa.array([k] * replicates) if k is not None else pa.nulls(replicates) for k in g]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(replicates), pa.int32()), *(pa.array(c) for c in total.T.copy())], names=[*by, "rep", *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "rep int", *(f"`{n}` double" for n in names)])
    typed = made.mapInArrow(lambda batches: (_cast(b, by, kinds) for b in add(batches)), schema)
    return typed.groupBy(*by, "rep").agg(*(F.sum(n).alias(n) for n in names))


def _cast(batch: pa.RecordBatch, by: list[str], kinds: dict[str, str]) -> pa.RecordBatch:
    """Group columns in the types that Spark expects."""
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "smallint": pa.int16(), "tinyint": pa.int8(), "float": pa.float32(), "date": pa.date32()}
    return pa.RecordBatch.from_arrays([c.cast(types[kinds[n]]) if n in by and kinds[n] in types else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)


def multinomial_sums(sums: DataFrame, block: str, by: list[str] | None = None, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """by, rep and the sums of the other columns over as many blocks as a group has, drawn with replacement.

    sums: one row a block, so a group has as many rows as the calendar; they meet in one task, which makes the draws.
    Draw d of replicate r is the block at place hash(seed, r, d) mod n in the order of block.
    """
    by = by or []
    names = [c for c in sums.columns if c not in (*by, block)]
    kinds = dict(sums.dtypes)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(block)
        x = pdf[names].astype(float).fillna(0.0).to_numpy()
        drawn = np.concatenate([x[k].sum(1) for k in block_draws(len(x), replicates, seed)])
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "rep": np.arange(replicates, dtype=np.int32), **{n: drawn[:, k] for k, n in enumerate(names)}})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "rep int", *(f"`{n}` double" for n in names)])
    return sums.groupBy(*by).applyInPandas(draw, schema)
