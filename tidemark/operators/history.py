"""Running state of entities: shrinkage, recency, and sums that exclude the block at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scan import running

def with_prior(value: Column | str, prior: float, n: Column | str, name: str) -> list[Column]:
    """AG-06. The value or the prior in its place, and flags `_missing` (no fact at all) and `_imputed`."""
    v = F.col(value) if isinstance(value, str) else value
    count = F.col(n) if isinstance(n, str) else n
    return [F.coalesce(v, F.lit(float(prior))).alias(name), (F.coalesce(count, F.lit(0)) == 0).alias(f"{name}_missing"), v.isNull().alias(f"{name}_imputed")]


def weighted_mean(value: str, volume: str) -> Column:
    """AG-07. An aggregate: weights are max(volume, 1); null values weigh nothing."""
    w = F.when(F.col(value).isNotNull(), F.greatest(F.coalesce(F.col(volume), F.lit(0)), F.lit(1)))
    return F.sum(F.col(value) * w) / F.sum(w)


def weighted_mean_over(value: str, volume: str, window) -> Column:
    """AG-07. The same along a window."""
    w = F.when(F.col(value).isNotNull(), F.greatest(F.coalesce(F.col(volume), F.lit(0)), F.lit(1)))
    return F.sum(F.col(value) * w).over(window) / F.sum(w).over(window)


def recency_mean(facts: DataFrame, key: list[str], order: list[str], value: str, k: int, decay: float, name: str) -> DataFrame:
    """AG-08. Facts with the mean of the last k non-null values, itself included, each weighing decay times the next one.

    The frame of k rows is taken over rows with a value; rows without one carry the latest mean forward.
    """
    w = Window.partitionBy(*key, F.col(value).isNotNull()).orderBy(*order).rowsBetween(-(k - 1), 0)
    last = F.collect_list(F.col(value).cast("double")).over(w)
    n = F.size("_last")
    weights = F.transform("_last", lambda x, i: F.pow(F.lit(float(decay)), (n - 1 - i).cast("double")))
    top = F.aggregate(F.zip_with("_last", weights, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    made = facts.withColumn("_last", last).withColumn("_m", F.when(F.col(value).isNotNull(), top / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)))
    run = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return made.withColumn(name, F.last("_m", ignorenulls=True).over(run)).drop("_last", "_m")


def half_life_weight(age: Column | str, half_life: float) -> Column:
    """AG-08. 0.5 ** (age / half_life)."""
    return F.pow(F.lit(0.5), (F.col(age) if isinstance(age, str) else age) / half_life)


def completed_age(facts: DataFrame, order: list[str], completed: Column, key: list[str], name: str = "age") -> DataFrame:
    """AG-08. How many completed facts of the key come after each one."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return facts.withColumn(name, F.coalesce(F.count_if(completed).over(w), F.lit(0)))


def shrunk(value: Column | str, n: Column | str, prior: Column | float, k: float) -> Column:
    """AG-09. w * value + (1 - w) * prior with w = n / (n + k); the prior if there is no value."""
    v, m = (F.col(x) if isinstance(x, str) else x for x in (value, n))
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    w = m / (m + F.lit(float(k)))
    return F.when(v.isNull() | m.isNull(), p).otherwise(w * v + (1 - w) * p)


def entering_state(updates: DataFrame, key: list[str], block: str = "block_ord", sums: tuple[str, ...] = ("num", "den", "n"), sliced: bool = False) -> DataFrame:
    """WN-05. For each key and block with updates: sums over strictly earlier blocks. One shuffle on the key.

    The frame runs to the block before by value, so rows of one block never see each other. sliced: a key's blocks are
    cut into ranges over many tasks.
    """
    per = updates.groupBy(*key, block).agg(*(F.sum(c).alias(c) for c in sums))
    if sliced:
        kinds = dict(per.dtypes)
        out = running(per, key, [block], {f"_{c}": c for c in sums}, own=False)
        return out.select(*key, block, *(F.coalesce(f"_{c}", F.lit(0)).cast(kinds[c]).alias(c) for c in sums))
    w = Window.partitionBy(*key).orderBy(block).rangeBetween(Window.unboundedPreceding, -1)
    return per.select(*key, block, *(F.coalesce(F.sum(c).over(w), F.lit(0)).cast(dict(per.dtypes)[c]).alias(c) for c in sums))


def leaving_state(updates: DataFrame, key: list[str], block: str = "block_ord", sums: tuple[str, ...] = ("num", "den", "n")) -> DataFrame:
    """WN-05. The same sums with the block included, for as-of picks by entities that sat a block out."""
    per = updates.groupBy(*key, block).agg(*(F.sum(c).alias(c) for c in sums))
    w = Window.partitionBy(*key).orderBy(block).rangeBetween(Window.unboundedPreceding, 0)
    return per.select(*key, block, *(F.sum(c).over(w).alias(c) for c in sums))


def rate(num: str = "num", den: str = "den", minimum: float = 1.0) -> Column:
    """WN-05. num / den, null while den is under the minimum."""
    return F.when(F.col(den) >= minimum, F.col(num) / F.col(den))


def matchup(rate_for: Column | str, rate_against: Column | str) -> Column:
    """WN-06. The mean of what one side makes and the other allows; null unless both are known."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (rate_for, rate_against))
    return (a + b) / 2


def matchups(games: DataFrame, states: DataFrame, families: dict[str, tuple[str, str, float]], block: str = "block_ord", home: str = "home", away: str = "away", prefix: str = "", missing: bool = False) -> DataFrame:
    """WN-06. games with away_<prefix><family> and home_<prefix><family> for each family: (metric made, metric allowed,
    least denominator); with `missing` each followed by <column>_missing, 1 where the matchup is null and 0 elsewhere.

    states: entity, metric, block, num, den, n after the block (leaving_state). The latest block before the game's
    counts: each entity and block that plays is picked once, over as many rows as the calendar has, and games find
    both their sides by entity and block.
    """
    from tidemark.operators.asof import asof

    made = {m: k for k, m in enumerate(dict.fromkeys(m for a, b, _ in families.values() for m in (a, b)))}
    # one row an entity and block, with every metric's latest state carried along
    wide = states.groupBy("entity", block).agg(*(F.max(F.when(F.col("metric") == m, F.struct("num", "den"))).alias(f"_m{k}") for m, k in made.items()))
    w = Window.partitionBy("entity").orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    values = [f"_m{k}" for k in made.values()]
    wide = wide.select("entity", (F.col(block) + 1).alias("_usable"), *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))
    calendar = games.select(F.explode(F.array(home, away)).alias("entity"), block).distinct()
    picked = asof(calendar, wide, ["entity"], block, "_usable", values)
    out = games
    for side, column in (("h", home), ("a", away)):
        facts = picked.select(F.col("entity").alias(column), block, *(F.col(v).alias(f"{v}{side}") for v in values))
        out = out.join(facts, [column, block], "left")

    def known(metric: str, side: str, least: float) -> Column:
        s = F.col(f"_m{made[metric]}{side}")
        return F.when(s["den"] >= least, s["num"] / s["den"])

    cols = []
    for name, (a, b, least) in families.items():
        for side, x, y in (("away", "a", "h"), ("home", "h", "a")):
            value = matchup(known(a, x, least), known(b, y, least))
            cols += [value.alias(f"{side}_{prefix}{name}")] + ([value.isNull().cast("int").alias(f"{side}_{prefix}{name}_missing")] if missing else [])
    return out.select(*games.columns, *cols)
