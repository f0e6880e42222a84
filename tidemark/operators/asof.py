"""Point-in-time picks: what was known at a cutoff, without a range join.

Facts and targets of an entity are tagged (fact 0, target 1), unioned and sorted by (time, tag); the last fact
before a target is then a window frame that runs along one sort of each entity. A fact available exactly at the
cutoff counts. One entity's rows share a partition, unless a timeline is asked for in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.scan import running


def asof(targets: DataFrame, facts: DataFrame, key: list[str], as_of: str, available: str, values: list[str], tie: list[str] | None = None, sliced: bool = False) -> DataFrame:
    """WN-00, JN-03. targets with each value of the entity's latest fact available at or before as_of, null if there is none.

    tie orders facts of one time; the greatest wins. A target with a null key or cutoff finds nothing. sliced: timelines are
    cut into slices over many tasks, and the last fact of a slice enters the next; for entities that hold a large share of
    the rows, at the price of one more pass through the shared folder.
    """
    tie = tie or []
    cols = [*values, *(t for t in tie if t not in values)]
    f = facts.where(F.col(available).isNotNull()).select(*key, F.col(available).alias("_t"), F.lit(0).alias("_kind"), F.struct(*(F.col(c) for c in cols)).alias("_fact"), *(F.col(t).alias(f"_tie{k}") for k, t in enumerate(tie)))
    names = [c for c in targets.columns if c not in key]
    t = targets.select(*key, F.col(as_of).alias("_t"), F.lit(1).alias("_kind"), F.struct(*names).alias("_target"))
    both = f.unionByName(t, allowMissingColumns=True)
    # targets that can find nothing are spread, not gathered under the null key
    lost = F.col("_t").isNull()
    for k in key:
        lost = lost | F.col(k).isNull()
    both = both.withColumn("_apart", F.when(lost, F.xxhash64("_target")).otherwise(F.lit(0).cast("long")))
    order = ["_t", "_kind", *(f"_tie{k}" for k in range(len(tie)))]
    if sliced:
        picked = running(both, [*key, "_apart"], order, lasts={"_seen": "_fact"}).where("_kind = 1")
    else:
        w = Window.partitionBy(*key, "_apart").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        picked = both.withColumn("_seen", F.last("_fact", ignorenulls=True).over(w)).where("_kind = 1")
    known = ~lost
    clash = [v for v in values if v in targets.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    return picked.select(*key, "_target.*", *(F.when(known, F.col(f"_seen.{v}")).alias(v) for v in values))


def rolled(facts: DataFrame, key: list[str], order: list[str], columns: list[str], sizes: list[int], season: str | None = None, prefix: str = "roll") -> DataFrame:
    """WN-01. Facts with mean, sum, population deviation (null under two) and number of each column's last k facts, itself included."""
    by = [*key, season] if season else key
    out = {}
    for k in sizes:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(k - 1), 0)
        for c in columns:
            n = F.count(c).over(w)
            out |= {f"{prefix}{k}_{c}_mean": F.avg(c).over(w), f"{prefix}{k}_{c}_sum": F.sum(c).over(w), f"{prefix}{k}_{c}_std": F.when(n >= 2, F.stddev_pop(c).over(w)), f"{prefix}{k}_{c}_n": n}
    return facts.withColumns(out)


def season_to_date(facts: DataFrame, key: list[str], season: str, order: list[str], columns: list[str], prefix: str = "std") -> DataFrame:
    """WN-02. Facts with mean, sum and number of each column since the season began, and the number of facts."""
    w = Window.partitionBy(*key, season).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = {f"{prefix}_n": F.count(F.lit(1)).over(w)}
    for c in columns:
        out |= {f"{prefix}_{c}_mean": F.avg(c).over(w), f"{prefix}_{c}_sum": F.sum(c).over(w), f"{prefix}_{c}_n": F.count(c).over(w)}
    return facts.withColumns(out)


def closing(facts: DataFrame, key: list[str], season: str | None, available: str, tie: list[str], columns: list[str], sizes: list[int]) -> DataFrame:
    """WN-01, WN-02. The last fact of each key and time, with the columns of `rolled` and, given a season, of `season_to_date`.

    No other fact can be picked as of a cutoff. A time's facts are cut to its last max(sizes) before keys' timelines are
    sorted, and seasons are running sums over times, so a key that holds much of the rows is many tasks.
    """
    newest = Window.partitionBy(*key, available).orderBy(*(F.col(c).desc() for c in tie))
    tail = facts.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= max(sizes))
    last = rolled(tail, key, [available, *tie], columns, sizes).where("_place = 1").drop("_place")
    if season is None:
        return last
    group = [*key, season]
    per = facts.groupBy(*group, available).agg(F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"_{name}_{c}") for c in columns for name, f in (("sum", F.sum), ("n", F.count))))
    w = Window.partitionBy(*group).orderBy(available).rowsBetween(Window.unboundedPreceding, 0)
    out = {"std_n": F.sum("_n").over(w)}
    kinds = dict(facts.select(*(F.avg(c).alias(c) for c in columns)).dtypes)
    for c in columns:
        total, n = F.sum(f"_sum_{c}").over(w), F.sum(f"_n_{c}").over(w)
        out |= {f"std_{c}_mean": F.when(n > 0, total / n).cast(kinds[c]), f"std_{c}_sum": total, f"std_{c}_n": n}
    return found(last, per.select(*group, available, *(v.alias(k) for k, v in out.items())), [*group, available])


def found(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """rows with the other columns of the table's one row of the same key, null if there is none; null keys are equal."""
    other = table.select(*(F.col(c).alias(f"_of_{c}") if c in key else F.col(c) for c in table.columns))
    on = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), key, F.lit(True))
    return rows.join(other, on, "left").drop(*(f"_of_{c}" for c in key))


def carried_rolls(targets: DataFrame, facts: DataFrame, key: list[str], season: str, as_of: str, available: str, column: str, tie: list[str], minimum: int = 3, carry: int = 4, short: int = 4, long: int = 8) -> DataFrame:
    """WN-03. Means of the last `short` and `long` facts; until a season has `minimum` facts, up to `carry` facts of
    earlier seasons stand in before them.

    With c facts this season, the frame under the minimum holds the last carry + c facts of all, cut to the size;
    above it, the season's own. Both are fixed frames, computed on the facts and picked as of the cutoff.
    """
    order = [available, *tie]
    w = Window.partitionBy(*key).orderBy(*order)
    s = Window.partitionBy(*key, season).orderBy(*order)
    frames = {f"_all{k}": F.avg(column).over(w.rowsBetween(-(k - 1), 0)) for k in sorted({min(size, carry + c) for size in (short, long) for c in range(minimum)})}
    own = {f"_own{k}": F.avg(column).over(s.rowsBetween(-(k - 1), 0)) for k in (short, long)}
    in_season = F.count(F.lit(1)).over(s.rowsBetween(Window.unboundedPreceding, 0))
    made = facts.withColumns({**frames, **own, "_c": in_season, "_fact_season": F.col(season)})
    values = [*frames, *own, "_c", "_fact_season"]
    picked = asof(targets, made.select(*key, available, *(t for t in tie if t not in values), *values), key, as_of, available, values, tie)
    c = F.when(F.col("_fact_season") == F.col(season), F.col("_c")).otherwise(F.lit(0))

    def roll(size: int):
        out = F.when(c >= minimum, F.col(f"_own{size}"))
        for k in range(minimum):
            n = min(size, carry + k)
            out = out.when(c == k, F.col(f"_all{n}"))
        return F.when(F.col("_fact_season").isNotNull(), out)

    return picked.select(*targets.columns, c.cast("long").alias("season_n"), roll(short).alias(f"roll{short}"), roll(long).alias(f"roll{long}"))


def week_gap(targets: DataFrame, week: str, last_week: str) -> DataFrame:
    """WN-07. Weeks since the last fact, and whether one was skipped."""
    gap = F.col(week) - F.col(last_week)
    return targets.withColumns({"week_gap": gap, "after_bye": F.coalesce(gap > 1, F.lit(False))})


def first_per_key(df: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """WN-09, ST-06, ST-07. The first n rows of each key in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


class _Board:
    """The latest rank of each candidate, and who leads; a heap of the ranks in use, so that neither a row nor a target goes through all candidates."""

    def __init__(self) -> None:
        self.ranks: dict[str, float | None] = {}
        self.held: dict[float, set[str]] = {}
        self.heap: list[float] = []
        self.first: list[str] | None = None
        self.known = True

    def put(self, candidate: str, rank: float | None) -> None:
        old = self.ranks.get(candidate)
        self.ranks[candidate] = rank
        if old == rank:
            return
        self.known = False
        if old is not None:
            self.held[old].discard(candidate)
            if not self.held[old]:
                del self.held[old]
        if rank is not None:
            if rank not in self.held:
                self.held[rank] = set()
                heappush(self.heap, rank)
            self.held[rank].add(candidate)
        if len(self.heap) > 2 * len(self.held) + 64:
            self.heap = sorted(self.held)

    def leaders(self) -> list[str] | None:
        if not self.known:
            while self.heap and self.heap[0] not in self.held:
                heappop(self.heap)
            self.first = sorted(self.held[self.heap[0]]) if self.heap else None
            self.known = True
        return self.first


def resolved(targets: DataFrame, evidence: DataFrame, key: list[str], candidate: str, rank: str, time: str, as_of: str, label: str) -> DataFrame:
    """JN-04. The candidate that the evidence before the cutoff names: state and candidates of each target.

    Each candidate counts with its latest row at or before as_of, the lowest rank of those if several; the lowest
    rank leads; two leaders are AMBIGUOUS, one has the state `label`, none UNKNOWN. Rows without a candidate or time
    are ignored, those without a rank never lead; a target with a null key or cutoff is UNKNOWN. Evidence and targets
    of a key are sorted by time together and streamed; a task holds the ranks of one key's candidates, never its rows.
    A rank that is no number is none.
    """
    e = evidence.where(F.col(candidate).isNotNull() & F.col(time).isNotNull()).withColumn(rank, F.nanvl(F.col(rank).cast("double"), F.lit(None).cast("double")))
    e = e.select(*key, F.col(time).cast("timestamp").alias("_t"), F.lit(0).alias("_kind"), F.col(candidate).cast("string").alias("_c"), F.col(rank).cast("double").alias("_r"))
    t = targets.select(*key, F.col(as_of).cast("timestamp").alias("_t"), F.lit(1).alias("_kind"), F.struct(*targets.columns).alias("_target"))
    both = e.unionByName(t, allowMissingColumns=True)
    lost = F.col("_t").isNull()
    for k in key:
        lost = lost | F.col(k).isNull()
    both = both.withColumns({"_key": F.to_json(F.struct(*key)), "_lost": lost}).withColumn("_key", F.when(F.col("_lost"), F.concat(F.lit("lost "), F.xxhash64("_target").cast("string"))).otherwise(F.col("_key")))
    kind = both.schema["_target"].dataType
    ordered = both.select("_key", "_lost", "_t", "_kind", "_c", "_r", "_target").repartition("_key").sortWithinPartitions("_key", "_t", "_kind", F.col("_r").desc_nulls_first())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, board = None, _Board()
        for batch in batches:
            kept, leaders = [], []
            for k, (name, lost_, is_target, c, r) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("_key", "_lost", "_kind", "_c", "_r")), strict=True)):
                if name != at:
                    at, board = name, _Board()
                if is_target:
                    kept.append(k)
                    leaders.append(None if lost_ else board.leaders())
                elif not lost_:
                    board.put(c, r)
            yield pa.RecordBatch.from_arrays([batch.column("_target").take(pa.array(kept, pa.int64())), pa.array(leaders, pa.list_(pa.string()))], names=["_target", "candidates"])

    schema = T.StructType([T.StructField("_target", kind), T.StructField("candidates", T.ArrayType(T.StringType()))])
    out = ordered.mapInArrow(rows, schema).select("_target.*", F.col("candidates").cast(T.ArrayType(evidence.schema[candidate].dataType)).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return out.withColumn("state", F.when(n > 1, "AMBIGUOUS").when(n == 1, label).otherwise("UNKNOWN"))


def cascade(df: DataFrame, tiers: list[tuple[str, str]], out: str = "candidates", state: str = "state") -> DataFrame:
    """JN-04. The first tier (columns of candidates and state) that isn't UNKNOWN; the last resort is UNKNOWN."""
    picked, name = F.lit(None).cast(dict(df.dtypes)[tiers[0][0]]), F.lit("UNKNOWN")
    for c, s in reversed(tiers):
        known = F.coalesce(F.col(s) != "UNKNOWN", F.lit(False))
        picked, name = F.when(known, F.col(c)).otherwise(picked), F.when(known, F.col(s)).otherwise(name)
    return df.withColumns({out: picked, state: name})
