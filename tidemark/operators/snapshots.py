"""Slowly changing snapshots: change ledgers, committed views, runs and their reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str], first: bool = False) -> DataFrame:
    """JN-12. One row for each tracked field that changed between two snapshots: key, field, old, new, change_type.

    A key that is new is one `first_seen` row, one that is gone one `dropped` row; a field is `populated` from null,
    `cleared` to null, else `changed`. Values are compared as strings. With `first` there is no snapshot before.
    """
    text = lambda df, side: df.select(F.col(key), F.lit(True).alias(f"_{side}"), *(F.col(f).cast("string").alias(f"_{side}_{f}") for f in fields))
    joined = text(before.limit(0) if first else before, "b").join(text(after, "a"), key, "full")
    new, gone = F.col("_b").isNull(), F.col("_a").isNull()
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_b_{f}").alias("old"), F.col(f"_a_{f}").alias("new")) for f in fields))
    nothing = F.lit(None).cast("string")
    whole = F.array(F.struct(nothing.alias("field"), nothing.alias("old"), nothing.alias("new")))
    rows = joined.select(key, new.alias("_new"), gone.alias("_gone"), F.explode(F.when(new | gone, whole).otherwise(each)).alias("c"))
    old, now = F.col("c.old"), F.col("c.new")
    kind = F.when(F.col("_new"), "first_seen").when(F.col("_gone"), "dropped").when(old.isNull() & now.isNotNull(), "populated").when(old.isNotNull() & now.isNull(), "cleared").when(old != now, "changed")
    return rows.select(key, "c.field", "c.old", "c.new", kind.alias("change_type")).where("change_type is not null")


def history_changes(snapshots: DataFrame, key: str, snapshot: str, fields: list[str]) -> DataFrame:
    """JN-12. The ledger of all snapshots of a table at once: each record against the same key's record before, by lag.

    Keys that a snapshot lacks but the one before has are `dropped` there; one that returns is `first_seen` again.
    """
    order = snapshots.select(snapshot).distinct()
    numbered = order.withColumn("_n", F.row_number().over(Window.orderBy(snapshot)))  # one row a snapshot
    rows = snapshots.join(numbered, snapshot).select(key, snapshot, "_n", *(F.col(f).cast("string").alias(f) for f in fields))
    w = Window.partitionBy(key).orderBy("_n")
    rows = rows.withColumns({"_before": F.lag("_n").over(w), "_after": F.lead("_n").over(w), **{f"_old_{f}": F.lag(f).over(w) for f in fields}})
    seen = F.col("_before") == F.col("_n") - 1
    nothing = F.lit(None).cast("string")
    kind = lambda f: F.when(F.col(f"_old_{f}").isNull() & F.col(f).isNotNull(), "populated").when(F.col(f"_old_{f}").isNotNull() & F.col(f).isNull(), "cleared").when(F.col(f"_old_{f}") != F.col(f), "changed")
    item = lambda f, old, new, k: F.struct(f.alias("field"), old.alias("old"), new.alias("new"), k.alias("change_type"))
    each = F.array(*(item(F.lit(f), F.col(f"_old_{f}"), F.col(f), kind(f)) for f in fields))
    first = F.array(item(nothing, nothing, nothing, F.lit("first_seen")))
    made = rows.select(key, snapshot, F.explode(F.when(F.coalesce(seen, F.lit(False)), each).otherwise(first)).alias("c")).select(key, snapshot, "c.*").where("change_type is not null")
    gone = rows.where("_after is null or _after > _n + 1").select(key, (F.col("_n") + 1).alias("_n")).join(numbered, "_n")
    return made.unionByName(gone.select(key, snapshot, nothing.alias("field"), nothing.alias("old"), nothing.alias("new"), F.lit("dropped").alias("change_type")))


def observations(pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """JN-13. Both observations of a key side by side under pre_ and post_; neither fills the other's gaps."""
    named = lambda df, p: df.select(*key, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in key), F.lit(True).alias(f"{p}_observed"))
    out = named(pre, "pre").join(named(post, "post"), key, "full")
    return out.withColumns({f"{p}_observed": F.coalesce(f"{p}_observed", F.lit(False)) for p in ("pre", "post")})


def committed(rows: DataFrame, history: DataFrame, key: str, status: str = "status", done: str = "COMMITTED") -> DataFrame:
    """JN-20. Rows of committed snapshots."""
    return rows.join(history.where(F.col(status) == done).select(key), key, "left_semi")


def latest_successful(history: DataFrame, source: str, time: str, status: str = "status", done: str = "COMMITTED", before: str | None = None) -> DataFrame:
    """WN-09. Each source's latest committed snapshot, at or before a time if one is given."""
    ok = F.col(status) == done
    rows = history.where(ok & (F.col(time) <= F.lit(before).cast("timestamp")) if before else ok)
    w = Window.partitionBy(source).orderBy(F.col(time).desc(), *(F.col(c) for c in sorted(rows.columns) if c != time))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def assembled_runs(history: DataFrame, attempts: DataFrame, rows: DataFrame, walks: DataFrame, run: str = "run_id", done: str = "COMMITTED") -> DataFrame:
    """JN-25. Committed runs with the number of attempts, their states, rows and matched rows; runs without any part keep zeros."""
    runs = history.where(F.col("status") == done).dropDuplicates([run])
    a = attempts.groupBy(run).agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(F.col("outcome") == "success").alias("n_success"))
    r = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n_rows"))
    x = walks.groupBy(run).agg(F.count_if(F.col("status") == "MATCHED").alias("n_matched"))
    out = runs
    for part in (a, r, x):
        out = out.join(part, run, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_attempts", "n_success", "n_rows", "n_matched")})


def reliability(attempts: DataFrame, by: list[str], outcome: str, latency: str, methods: list[str], method: str) -> DataFrame:
    """AG-22. Attempts, successes, latency quantiles and counts of each known method, in one aggregate."""
    return attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(F.col(outcome) == "success").alias("n_success"),
        F.median(latency).alias("median_latency"),
        F.percentile(latency, 0.95).alias("p95_latency"),
        *(F.count_if(F.col(method) == m).alias(f"n_{m}") for m in methods),
    )
