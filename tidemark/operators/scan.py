"""Ordered work without an ordered task: running values, ranks and exact quantiles of groups of any size.

A window without keys, or under a key that holds half of the rows, sorts them in one task. Here the rows are cut by
ranges of (key, order) instead, so that a key is in as many slices as it needs; each slice is summed up in one row, these
rows are scanned, and what comes before a slice enters it as its first row. Quantiles need no order at all: counts of
value ranges are refined until a range holds one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.scratch import scratch

#: Ranges that an interval is cut into in a round of `quantiles`.
RANGES = 4096


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: what depends on where a row lies must not be computed twice."""
    out = scratch(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column | str] | None = None, lasts: dict[str, str] | None = None, own: bool = True) -> DataFrame:
    """df with running values of each group of `by` along `order`, ascending with nulls first.

    sums: name to what is added up (null adds nothing; null until something was added). lasts: name to a column whose
    latest value that isn't null is carried along. own: whether a row counts for itself. Equal to the same functions over
    Window.partitionBy(by).orderBy(order) with rows up to the current one (or the one before), save that sums of
    doubles add up in another order. No task holds more than one range of rows and, of a group, one row a range.
    """
    sums, lasts = sums or {}, lasts or {}
    value = {f"_sum_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    kept = {f"_last_{n}": F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))) for n, c in lasts.items()}
    keys = [F.col(c) for c in (*by, *order)]
    cut = stored(df.withColumns({**value, **kept}).repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), "slices")
    place = F.struct(*order)
    totals = cut.groupBy("_slice", *by).agg(*(F.sum(n).alias(n) for n in value), *(F.max_by(n, F.when(F.col(n).isNotNull(), place)).alias(n) for n in kept))
    # one row for each slice of a group
    whole = Window.partitionBy(*by, F.col("_slice") * 0).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_slice", *by, *(F.sum(n).over(whole).alias(n) for n in value), *(F.last(n, ignorenulls=True).over(whole).alias(n) for n in kept))
    both = cut.withColumn("_scan_row", F.lit(1)).unionByName(before.withColumn("_scan_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("_slice", *by).orderBy("_scan_row", *order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    made = {n: F.sum(f"_sum_{n}").over(w) for n in sums} | {n: F.last(f"_last_{n}", ignorenulls=True).over(w)["v"] for n in lasts}
    names = [c for c in df.columns if c not in made]
    return both.select("_scan_row", *names, *(c.alias(n) for n, c in made.items())).where("_scan_row = 1").drop("_scan_row")


def same(a: str, b: str, by: list[str]) -> Column:
    """Whether rows of the frames aliased a and b are of one group; null is a group."""
    return reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), by, F.lit(True))


def beside(rows: DataFrame, table: DataFrame, by: list[str], how: str = "inner", on: Column | None = None) -> DataFrame:
    """rows, aliased l, with the rows of their group in table, aliased r; without groups the table has a few rows, which all tasks get."""
    right = table.alias("r") if by else F.broadcast(table.alias("r"))
    return rows.alias("l").join(right, same("l", "r", by) if on is None else same("l", "r", by) & on, how)


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] | None = None, weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """by, n and a column for each of `at`: the exact quantile of the group's values, between neighbours linearly as `percentile` has it.

    weight: a column of whole numbers, how often a row counts. Null values and NaN don't count, nor do weights under 1; a
    group without a value has no row. Each round counts, in every interval that holds a wanted place, the rows of
    `ranges` ranges between its least and greatest value, and goes on with the ranges that hold those places, until they
    hold one value each: two or three rounds over the rows for values of ordinary spread. A task holds the ranges of a
    group's intervals, never its values.
    """
    by = by or []
    v, n = F.col(value).cast("double"), F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(*by, v.alias("_v"), n.alias("_w")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_w") > 0))
    whole = rows.groupBy(*by).agg(F.sum("_w").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("n > 0")
    whole = stored(whole, "quantile-groups")
    spot = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    places = F.array(*(F.struct(F.lit(name).alias("q"), F.lit(k).alias("end"), (F.floor(spot(q)) if k == 0 else F.ceil(spot(q))).cast("long").alias("k")) for name, q in at.items() for k in (0, 1)))
    todo = whole.select(*by, F.explode(places).alias("_p"), F.col("_low"), F.col("_high")).select(*by, "_p.*", "_low", "_high")
    done = None
    while True:
        todo = stored(todo, "quantile-places")
        found = todo.where("_low = _high").select(*by, "q", "end", F.col("_low").alias("x"))
        done = found if done is None else done.unionByName(found)
        todo = todo.where("_low < _high")
        if todo.isEmpty():
            break
        spans = todo.select(*by, "_low", "_high").distinct()
        inside = (F.col("l._v") >= F.col("r._low")) & (F.col("l._v") <= F.col("r._high"))
        held = beside(rows, spans, by, on=inside).select(*(F.col(f"l.{c}").alias(c) for c in by), "l._v", "l._w", "r._low", "r._high")
        # halves keep the width of any interval finite; rounding keeps the order of values, so ranges are in order
        share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        # the greatest value has a range of its own, so that an interval always shrinks
        part = F.when(F.col("_v") == F.col("_high"), ranges).when(F.col("_v") == F.col("_low"), -1).otherwise(F.least(F.floor(share * ranges), F.lit(ranges - 1))).cast("int")
        counts = held.groupBy(*by, "_low", "_high", part.alias("_part")).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "_low", "_high").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.select(*by, "_low", "_high", "_least", "_most", "_n", upto.alias("_upto"))
        l, r = todo.alias("l"), counts.alias("r")
        hit = same("l", "r", by) & (F.col("l._low") == F.col("r._low")) & (F.col("l._high") == F.col("r._high")) & (F.col("l.k") < F.col("r._upto")) & (F.col("l.k") >= F.col("r._upto") - F.col("r._n"))
        todo = l.join(r, hit).select(*(F.col(f"l.{c}").alias(c) for c in by), "l.q", "l.end", (F.col("l.k") - F.col("r._upto") + F.col("r._n")).alias("k"), F.col("r._least").alias("_low"), F.col("r._most").alias("_high"))
    ends = {f"_{name}_{k}": F.max(F.when((F.col("q") == name) & (F.col("end") == k), F.col("x"))) for name in at for k in (0, 1)}
    values = done.groupBy(*by).agg(*(c.alias(name) for name, c in ends.items()))
    out = beside(whole, values, by).select(*(F.col(f"l.{c}").alias(c) for c in by), "l.n", *ends)
    between = lambda name, q: F.col(f"_{name}_0") + (spot(q) - F.floor(spot(q))) * (F.col(f"_{name}_1") - F.col(f"_{name}_0"))
    return out.select(*by, "n", *(between(name, q).alias(name) for name, q in at.items()))
