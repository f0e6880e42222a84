"""Projections that change a table's shape: sides to columns and back, candidates, context, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wide_sides(long: DataFrame, key: list[str], side: str, sides: list[str], columns: list[str]) -> DataFrame:
    """PRJ-05, JN-19. One row a key with <side>_<column> for each side; the aggregate of a pivot with known values."""
    return long.groupBy(*key).agg(*(F.max(F.when(F.col(side) == s, F.col(c))).alias(f"{s}_{c}") for s in sides for c in columns))


def two_sided(games: DataFrame, home: dict[str, str], away: dict[str, str], keep: list[str], side: str = "side") -> DataFrame:
    """PRJ-06. Each row as two, home and away: new column name to the column it comes from."""
    if home.keys() != away.keys():
        raise ValueError("both sides need the same columns")
    make = lambda name, m: F.struct(F.lit(name).alias(side), *(F.col(c).alias(k) for k, c in m.items()))
    return games.select(*keep, F.explode(F.array(make("home", home), make("away", away))).alias("_s")).select(*keep, "_s.*")


def projected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """PRJ-10. Only the listed columns, under new names: new to old. A missing column is an error when the plan is built."""
    return df.select(*(F.col(old).alias(new) for new, old in columns.items()))


def standardised(df: DataFrame, schema: T.StructType, sources: dict[str, list[str]] | None = None) -> DataFrame:
    """PRJ-22. The schema's columns, each the first non-null of its sources that df has (itself by default), null if it has none."""
    out = []
    for f in schema.fields:
        have = [F.col(c).cast(f.dataType) for c in (sources or {}).get(f.name, [f.name]) if c in df.columns]
        out.append((F.coalesce(*have) if have else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def context(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """PRJ-11. Numbers with <name>_missing as 0/1, categories in lower case with `unknown` for null or empty."""
    made = {f"{n}_missing": F.col(n).isNull().cast("int") for n in numbers}
    made |= {c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown")) for c in categories}
    return df.withColumns(made)


def model_columns(df: DataFrame, prefixes: list[str], without: set[str] = frozenset(), text: bool = False) -> list[str]:
    """PRJ-16. Columns with one of the prefixes, without the listed ones, and without text unless asked for."""
    kinds = dict(df.dtypes)
    return [c for c in df.columns if c.startswith(tuple(prefixes)) and c not in without and (text or kinds[c] != "string")]


def scenarios(df: DataFrame, candidates: str, most: int = 2) -> DataFrame:
    """PRJ-18, ST-03. One row for each of the first candidates with its rank from 1, or one row with null if there is none."""
    kind = dict(df.dtypes)[candidates]
    some = F.slice(F.coalesce(candidates, F.array().cast(kind)), 1, most)
    rows = F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(None)).cast(kind))
    rest = [c for c in df.columns if c != candidates]
    return df.select(*rest, F.posexplode(rows).alias("_p", "candidate")).select(*rest, "candidate", F.when(F.col("candidate").isNotNull(), F.col("_p") + 1).alias("scenario_rank"))


def outcome_free(df: DataFrame, outcomes: list[str], contexts: list[DataFrame], key: list[str]) -> DataFrame:
    """PRJ-19, JN-18. Without outcome columns, with each context's columns joined on the key."""
    return reduce(lambda a, b: a.join(b, key, "left"), contexts, df.drop(*outcomes))


def warm(p: Column | str, warmup: Column | str) -> Column:
    """PRJ-20. The prediction, null in warm-up; an unknown warm-up counts as one."""
    w = F.col(warmup) if isinstance(warmup, str) else warmup
    return F.when(~w, F.col(p) if isinstance(p, str) else p)


def with_status(rows: DataFrame, fitted: DataFrame, key: list[str], p: str) -> DataFrame:
    """PRJ-21. Every row, with its prediction and status FITTED, or WARMUP and why: fitted has key, p and warmup_reason."""
    joined = rows.join(fitted.select(*key, p, "warmup_reason"), key, "left")
    reason = F.when(F.col(p).isNull(), F.coalesce("warmup_reason", F.lit("no_block")))
    return joined.withColumns({"status": F.when(F.col(p).isNull(), "WARMUP").otherwise("FITTED"), "warmup_reason": reason})


def stacked(frames: list[DataFrame], widen: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """SO-01, SO-02, SO-03. Rows of all frames by column name; widen fills columns that a frame lacks with null; schema casts each first."""
    if schema is not None:
        frames = [f.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in schema.fields if c.name in f.columns)) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=widen), frames)


def side_by_side(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """SO-04. Aligned frames joined on their key; rows have no positions to align by."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def canonical_side(df: DataFrame, side: str, keep: list[str], keys: list[str]) -> DataFrame:
    """SO-06. Mirrored rows once: those of the kept sides, one a key."""
    return df.where(F.col(side).isin(keep)).dropDuplicates(keys)


def null_profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """AG-21. Per group and column: rows, nulls, and rows with any null, from one aggregate unfolded to long."""
    by = by or []
    anything = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(anything).alias("n_any_null"), *(F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in columns))
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("n_null")) for c in columns)))
    return wide.select(*by, "n_rows", "n_any_null", long.alias("_c")).select(*by, "_c.column", "n_rows", "_c.n_null", "n_any_null")
