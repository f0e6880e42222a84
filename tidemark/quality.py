"""Data-quality gates: each returns a lazy frame of violations; `assert_clean` runs one small job.

A violation has the columns gate, detail and n (rows or keys affected). A gate over clean data returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION = "gate string, detail string, n long"


class QualityError(ValueError):
    """A gate found violations."""


def _violations(df: DataFrame, gate: str, detail: Column | str, n: Column | None = None) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _counted(df: DataFrame, gate: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over df: a violation for each rule with rows for which it is true."""
    totals = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, c in enumerate(rules.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("detail"), F.col(f"r{k}").alias("n")) for k, name in enumerate(rules))))
    return _violations(totals.select(rows.alias("v")).where("v.n > 0"), gate, F.col("v.detail"), F.col("v.n"))


def unique_key(df: DataFrame, keys: list[str], gate: str = "unique_key") -> DataFrame:
    """DQ-01, AG-01. Keys that occur twice, or hold a null."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | null)
    return _violations(groups, gate, F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)), F.col("_n"))


def in_window(df: DataFrame, column: str, low: object = None, high: object = None, gate: str = "window") -> DataFrame:
    """DQ-02, PRJ-08. Values outside [low, high]; null values are outside."""
    c = F.col(column)
    outside = c.isNull() | (c < low if low is not None else F.lit(False)) | (c > high if high is not None else F.lit(False))
    return _counted(df, gate, {f"{column} outside {low}..{high}": outside})


def sealed(df: DataFrame, column: str, last: object) -> DataFrame:
    """PRJ-08. The same rows, which fail the job when one beyond `last` is met."""
    return df.where(F.assert_true(F.coalesce(F.col(column) <= last, F.lit(False)), F.concat(F.lit(f"{column} is sealed after {last}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).isNull())


def coverage(left: DataFrame, right: DataFrame, keys: list[str], gate: str = "coverage") -> DataFrame:
    """DQ-03, JN-07. Keys of the left that the right lacks (missing) and the other way round (extra)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    name = F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    return _violations(a.join(b, keys, "left_anti"), gate, F.concat(F.lit("missing "), name)).unionByName(_violations(b.join(a, keys, "left_anti"), gate, F.concat(F.lit("extra "), name)))


def schema_matches(df: DataFrame, schema: T.StructType, gate: str = "schema") -> DataFrame:
    """DQ-04. Names, order and types, compared when the plan is built; no job."""
    have, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in schema]
    odd = [f"{k}: {a} is not {b}" for k, (a, b) in enumerate(zip(have, want, strict=False)) if a != b]
    odd += [f"extra {x}" for x in have[len(want) :]] + [f"missing {x}" for x in want[len(have) :]]
    return df.sparkSession.createDataFrame([(gate, d, 1) for d in odd], VIOLATION)


def utc_columns(df: DataFrame, columns: list[str], gate: str = "utc") -> DataFrame:
    """DQ-04. Columns that are no timestamps with a zone."""
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(gate, f"{c} is {kinds.get(c)}", 1) for c in columns if kinds.get(c) != "timestamp"], VIOLATION)


def forbidden_columns(df: DataFrame, names: Iterable[str] = (), tokens: Iterable[str] = (), gate: str = "forbidden") -> DataFrame:
    """PRJ-09. Columns with a forbidden name, or one of the tokens in theirs; no job."""
    names, tokens = set(names), list(tokens)
    found = [c for c in df.columns if c in names or any(t in c.lower() for t in tokens)]
    return df.sparkSession.createDataFrame([(gate, c, 1) for c in found], VIOLATION)


def fingerprint(df: DataFrame, digits: int = 9) -> DataFrame:
    """DQ-05. n_rows, schema_sha256 and content, a sum of row hashes that ignores the order of rows; doubles are rounded first."""
    cols = [F.round(c, digits) if kind in ("double", "float") else F.to_json(F.struct(c)) if kind.startswith(("map", "array", "struct")) else F.col(c) for c, kind in sorted(df.dtypes)]
    # nulls change a row's hash with their place
    hashes = F.xxhash64(*cols, *(F.col(c).isNull() for c in sorted(df.columns)))
    schema = ",".join(f"{c}:{k}" for c, k in sorted(df.dtypes))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(hashes.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content")).withColumn("schema_sha256", F.sha2(F.lit(schema), 256))


def manifest(tables: dict[str, DataFrame], season: str | None = None, as_of: str | None = None) -> DataFrame:
    """SNK-05. One row a table: rows, columns, range of seasons and cutoffs, fingerprints."""
    out = []
    for name, df in tables.items():
        extra = [f(F.col(c)).cast("string").alias(f"{a}_{b}") if c in df.columns else F.lit(None).cast("string").alias(f"{a}_{b}") for c, b in ((season, "season"), (as_of, "as_of")) for f, a in ((F.min, "first"), (F.max, "last"))]
        out.append(fingerprint(df).crossJoin(df.agg(*extra, F.lit(len(df.columns)).alias("n_columns"))).withColumn("name", F.lit(name)))  # one row each
    return reduce(DataFrame.unionByName, out)


def invariants(df: DataFrame, rules: dict[str, Column], gate: str = "invariant") -> DataFrame:
    """DQ-06, DQ-15. Rows for which a rule is not true; a null counts as broken."""
    return _counted(df, gate, {name: ~F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})


def outcome_rules(win: str, tie: str, margin: str) -> dict[str, Column]:
    """DQ-06. The sign of the margin goes with win (null on a tie) and tie."""
    m, w, t = F.col(margin), F.col(win), F.col(tie)
    return {"sign of margin": F.when(m.isNull(), w.isNull() & ~t).when(m == 0, w.isNull() & t).otherwise((w == (m > 0)) & ~t)}


def pairs(df: DataFrame, key: list[str], side: str, sides: tuple[str, str], change: str | None = None, tolerance: float = 1e-9, gate: str = "pairs") -> DataFrame:
    """DQ-07. Groups without exactly one row of each side, or whose changes don't add up to zero."""
    a, b = (F.count_if(F.col(side) == s) for s in sides)
    off = F.lit(False) if change is None else F.coalesce(F.abs(F.sum(change)) > tolerance, F.lit(True))
    groups = df.groupBy(*key).agg((~((a == 1) & (b == 1) & (F.count(F.lit(1)) == 2)) | off).alias("_bad")).where("_bad")
    return _violations(groups, gate, F.concat_ws(",", *(F.col(k).cast("string") for k in key)))


def complete_blocks(expected: DataFrame, observed: DataFrame, key: list[str], gate: str = "complete") -> DataFrame:
    """DQ-08. Expected keys that were not observed exactly once, and observed keys that were not expected."""
    a, b = expected.groupBy(*key).agg(F.lit(1).alias("_e")), observed.groupBy(*key).agg(F.count(F.lit(1)).alias("_o"))
    joined = a.join(b, key, "full").where("_e is null or _o is null or _o <> 1")
    return _violations(joined, gate, F.concat_ws(",", *(F.col(k).cast("string") for k in key)), F.coalesce("_o", F.lit(0)))


def single_valued(df: DataFrame, key: list[str], column: str, gate: str = "single_valued") -> DataFrame:
    """DQ-09. Groups with two different non-null values."""
    groups = df.groupBy(*key).agg((F.min(column) != F.max(column)).alias("_bad"), F.count(column).alias("_n")).where("_bad")
    return _violations(groups, gate, F.concat_ws(",", *(F.col(k).cast("string") for k in key)), F.col("_n"))


def leakage(facts: DataFrame, available: str, as_of: str, same_event: Column, gate: str = "leakage") -> DataFrame:
    """DQ-10. Counts of joined facts by eligibility: n_eligible, n_after_cutoff, n_same_event."""
    late = F.col(available) > F.col(as_of)
    return facts.agg(F.count_if(~late & ~same_event).alias("n_eligible"), F.count_if(late).alias("n_after_cutoff"), F.count_if(same_event).alias("n_same_event"))


def equal_ledgers(left: DataFrame, right: DataFrame, keys: list[str], gate: str = "equal") -> DataFrame:
    """DQ-11, DQ-14. Columns that differ between rows of one key, and keys on one side alone; nulls are equal."""
    values = [c for c in left.columns if c not in keys]
    b = right.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in values), F.lit(True).alias("_right"))
    joined = left.withColumn("_left", F.lit(True)).join(b, keys, "full")
    both = F.col("_left") & F.col("_right")
    rules = {"key on one side": ~F.coalesce(both, F.lit(False))} | {f"column {c}": both & ~F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in values}
    return _counted(joined, gate, rules)


def expected_counts(df: DataFrame, key: str, expected: dict[object, int], gate: str = "counts") -> DataFrame:
    """DQ-12. Groups whose number of rows isn't the expected one."""
    kind = dict(df.dtypes)[key]
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{key} {kind}, _want long")
    joined = df.groupBy(key).agg(F.count(F.lit(1)).alias("_have")).join(want, key, "full").where("coalesce(_have, 0) <> coalesce(_want, 0)")
    return _violations(joined, gate, F.concat(F.col(key).cast("string"), F.lit(": expected "), F.coalesce("_want", F.lit(0)).cast("string")), F.coalesce("_have", F.lit(0)))


def once_per_block(df: DataFrame, block: list[str], entities: list[str], gate: str = "once") -> DataFrame:
    """DQ-17. Entities that take part twice in one block, whichever side they are on."""
    each = df.select(*block, F.explode(F.array(*entities)).alias("_entity"))
    return unique_key(each, [*block, "_entity"], gate)


def finite(df: DataFrame, columns: list[str], gate: str = "finite") -> DataFrame:
    """DQ-18. Columns with NaN or infinite values, or that hold no numbers."""
    kinds = dict(df.dtypes)
    number = [c for c in columns if kinds[c].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))]
    wrong = df.sparkSession.createDataFrame([(gate, f"{c} is {kinds[c]}", 1) for c in columns if c not in number], VIOLATION)
    return wrong.unionByName(_counted(df, gate, {c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in number})) if number else wrong


def changed_summaries(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-16. Two versions of a summary side by side: each number's value before, after and the difference."""
    values = [c for c in before.columns if c not in keys]
    named = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{c}_{p}") for c in values))
    joined = named(before, "before").join(named(after, "after"), keys, "full")
    return joined.select("*", *((F.coalesce(F.col(f"{c}_after"), F.lit(0)) - F.coalesce(F.col(f"{c}_before"), F.lit(0))).alias(f"{c}_delta") for c in values))


def union(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def assert_clean(*gates: DataFrame, show: int = 5) -> None:
    """Runs the gates as one job and raises with the first violations."""
    if found := union(*gates).limit(show).collect():
        raise QualityError("; ".join(f"{r.gate}: {r.detail} ({r.n})" for r in found))


def no_violations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VIOLATION)
