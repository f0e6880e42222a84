"""Quality of probabilistic predictions: losses, calibration, ranking, comparison, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.odds import normal_cdf
from tidemark.operators.bootstrap import multinomial_sums, poisson_sums
from tidemark.operators.scan import beside, quantiles, running, same

EPS = 1e-15


def brier(p: str, y: str) -> Column:
    return F.pow(F.col(p) - F.col(y).cast("double"), F.lit(2.0))


def log_loss(p: str, y: str, eps: float = EPS) -> Column:
    """Of a probability clamped to [eps, 1 - eps]."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return -F.when(F.col(y).cast("int") == 1, F.log(q)).otherwise(F.log(1 - q))


def scores(p: str, y: str, closed: bool = True) -> list[Column]:
    """AG-25. Aggregates n, brier, log_loss and accuracy; rows with a null p or y count nowhere.

    closed: a probability of exactly one half predicts 1 (>=), else 0 (>).
    """
    ok = F.col(p).isNotNull() & F.col(y).isNotNull()
    says = (F.col(p) >= 0.5) if closed else (F.col(p) > 0.5)
    of = lambda c: F.avg(F.when(ok, c))
    return [F.count_if(ok).alias("n"), of(brier(p, y)).alias("brier"), of(log_loss(p, y)).alias("log_loss"), of((says == (F.col(y).cast("int") == 1)).cast("double")).alias("accuracy")]


def tie_as_loss(y: str, tie: str) -> Column:
    """AG-25. The other convention: a tie is 0 instead of null."""
    return F.when(F.col(tie), 0).otherwise(F.col(y).cast("int"))


def bin_index(p: str, bins: int = 10) -> Column:
    """AG-27. Half-open bins of equal width, the last closed."""
    return F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")


def reliability_table(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """AG-27. For each bin, empty ones too: its edges, n, mean prediction, observed rate, gap."""
    by = by or []
    ok = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    per = ok.groupBy(*by, bin_index(p, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    every = df.select(*by).distinct().join(grid, F.lit(True), "inner") if by else grid  # groups times a few bins
    out = every.join(per, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "observed", (F.col("mean_p") - F.col("observed")).alias("gap"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """AG-27. One row: the gaps of a reliability table, weighed by n."""
    return table.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def _ranked(per: DataFrame, by: list[str], name: str) -> DataFrame:
    """per, one row for each value `_v` of a group with its number of rows `_n`, with the mean rank of the value.

    Values are ranked by a scan over ranges of them, so a group, or all rows, may hold any number of different values.
    """
    summed = running(per, by, ["_v"], {"_upto": "_n"})
    return summed.withColumn(name, F.col("_upto") - (F.col("_n") - 1) / 2.0).drop("_upto")


def average_rank(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """WN-13. df with the mean rank of equal values, from 1; rows without a value are left out.

    Ranks come from counts of distinct values, so ties cost nothing.
    """
    by = by or []
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = _ranked(per, by, name).drop("_n")
    return df.alias("l").join(ranks.alias("r"), same("l", "r", by) & (F.col(f"l.{value}") == F.col("r._v"))).select("l.*", f"r.{name}")


def auc(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """AG-26. Area under the ROC curve with ties at their mean rank; null when one class is missing."""
    by = by or []
    ok = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    per = ok.groupBy(*by, F.col(p).alias("_v")).agg(F.count_if(F.col(y).cast("int") == 1).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    ranked = _ranked(per, by, "_r")
    pos, neg = F.sum("_pos").cast("double"), (F.sum("_n") - F.sum("_pos")).cast("double")
    return ranked.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), (F.sum(F.col("_r") * F.col("_pos")) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"), F.sum("_pos").alias("n_pos"), (F.sum("_n") - F.sum("_pos")).alias("n_neg"))


def regression_scores(df: DataFrame, predicted: str, actual: str, block: str, by: list[str] | None = None) -> DataFrame:
    """AG-24. n, bias, MAE, RMSE, Pearson, Spearman (of mean ranks) and the sample deviation of the blocks' RMSE."""
    by = by or []
    ok = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    ranked = average_rank(average_rank(ok, predicted, "_rp", by), actual, "_ra", by)
    e = F.col(predicted) - F.col(actual)
    per = ranked.groupBy(*by, block).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e).alias("se"), F.sum(F.abs(e)).alias("sa"), F.sum(e * e).alias("ss"),
        *(F.sum(c).alias(k) for k, c in {"p": F.col(predicted), "a": F.col(actual), "pp": F.col(predicted) ** 2, "aa": F.col(actual) ** 2, "pa": F.col(predicted) * F.col(actual), "rp": F.col("_rp"), "ra": F.col("_ra"), "rpp": F.col("_rp") ** 2, "raa": F.col("_ra") ** 2, "rpa": F.col("_rp") * F.col("_ra")}.items()),
    )
    n = F.sum("n").cast("double")
    correlation = lambda a, b, aa, bb, ab: (n * F.sum(ab) - F.sum(a) * F.sum(b)) / F.nullif(F.sqrt((n * F.sum(aa) - F.sum(a) ** 2) * (n * F.sum(bb) - F.sum(b) ** 2)), F.lit(0.0))
    return per.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("se") / n).alias("bias"), (F.sum("sa") / n).alias("mae"), F.sqrt(F.sum("ss") / n).alias("rmse"), correlation("p", "a", "pp", "aa", "pa").alias("pearson"), correlation("rp", "ra", "rpp", "raa", "rpa").alias("spearman"), F.stddev_samp(F.sqrt(F.col("ss") / F.col("n"))).alias("block_rmse_std"))


def paired_losses(a: DataFrame, b: DataFrame, key: list[str], p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """AG-28. Of rows that both have: mean Brier and log-loss deltas (b minus a), skill score, counts of better, worse and equal, mean and median absolute change."""
    by = by or []
    left = a.select(*key, *by, F.col(y).cast("int").alias("_y"), F.col(p).alias("_pa"))
    both = left.join(b.select(*key, F.col(p).alias("_pb")), key).where("_y is not null and _pa is not null and _pb is not null")
    la, lb = brier("_pa", "_y"), brier("_pb", "_y")
    d = lb - la
    means = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(la).alias("brier_a"),
        F.avg(lb).alias("brier_b"),
        F.avg(d).alias("brier_delta"),
        F.avg(log_loss("_pb", "_y") - log_loss("_pa", "_y")).alias("log_loss_delta"),
        (1 - F.avg(lb) / F.nullif(F.avg(la), F.lit(0.0))).alias("skill"),
        F.count_if(d < 0).alias("n_better"),
        F.count_if(d > 0).alias("n_worse"),
        F.count_if(d == 0).alias("n_equal"),
        F.avg(F.abs(F.col("_pb") - F.col("_pa"))).alias("mean_change"),
    )
    middle = quantiles(both.withColumn("_d", F.abs(F.col("_pb") - F.col("_pa"))), "_d", {"median_change": 0.5}, by)
    return beside(means, middle, by, "left").select("l.*", "r.median_change")


def season_stability(per_season: DataFrame, season: str, delta: str) -> DataFrame:
    """AG-29. How many seasons got better (delta under 0) or worse, and the extremes."""
    d = F.col(delta)
    return per_season.agg(F.count_if(d < 0).alias("n_improved"), F.count_if(d > 0).alias("n_worsened"), F.min_by(season, F.struct(d, F.col(season))).alias("strongest"), F.max_by(season, F.struct(d, F.col(season))).alias("weakest"))


def segments(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """AG-30. Each row once for every segment that it is in, in a column `segment`; group by it for all segments at once."""
    held = F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))
    return df.select("*", F.explode(held).alias("segment"))


def block_sums(df: DataFrame, block: str, values: dict[str, Column]) -> DataFrame:
    """AG-31. The sufficient statistics of a block bootstrap: one row a block."""
    return df.groupBy(block).agg(*(F.sum(c).alias(name) for name, c in values.items()))


def _interval(reps: DataFrame, value: str, level: float, by: list[str]) -> DataFrame:
    """by, low, high, se and n_replicates of the replicates' values, which are few."""
    tail = (1 - level) / 2
    return reps.groupBy(*by).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.stddev_samp(value).alias("se"), F.count(value).alias("n_replicates"))


def bootstrap(sums: DataFrame, block: str, statistic: Column, replicates: int = 1000, seed: int = 0, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """AG-31. The interval of a statistic (an aggregate over block sums) when whole blocks are drawn with replacement.

    A group's block sums, as many as the calendar has blocks, meet in one task, which adds up every replicate's draws.
    """
    by = by or []
    reps = multinomial_sums(sums, block, by, replicates, seed).groupBy(*by, "rep").agg(statistic.alias("_s"))
    return beside(sums.groupBy(*by).agg(statistic.alias("estimate")), _interval(reps, "_s", level, by), by).select(*(f"l.{c}" for c in by), "l.estimate", "r.low", "r.high", "r.se", "r.n_replicates")


def bootstrap_rows(rows: DataFrame, key: list[str], values: dict[str, Column], statistic: Column, replicates: int = 1000, seed: int = 0, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """AG-31 over single rows. The interval of a statistic (an aggregate of the sums of values) under Poisson weights of each row.

    Any number of rows: each is weighed in all replicates where it is read, and only sums are shuffled.
    """
    by = by or []
    reps = poisson_sums(rows, key, values, by, replicates, seed).groupBy(*by, "rep").agg(statistic.alias("_s"))
    sums = rows.groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in values.items()))
    return beside(sums.groupBy(*by).agg(statistic.alias("estimate")), _interval(reps, "_s", level, by), by).select(*(f"l.{c}" for c in by), "l.estimate", "r.low", "r.high", "r.se", "r.n_replicates")


def bootstrap_difference(sums: DataFrame, block: str, period: str, periods: tuple[object, object], statistic: Column, replicates: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """AG-31. The interval of the difference of a statistic between two periods, whole blocks drawn with replacement in each by itself.

    One row: value_a, value_b, difference (b minus a), low, high and n_replicates. Draws are those of `bootstrap`.
    """
    two = sums.where(F.col(period).isin(*periods))
    each = lambda k: F.max(F.when(F.col(period) == periods[k], F.col("_s")))
    reps = multinomial_sums(two, block, [period], replicates, seed).groupBy("rep", period).agg(statistic.alias("_s")).groupBy("rep").agg((each(1) - each(0)).alias("_d"))
    ci = _interval(reps, "_d", level, [])
    point = two.groupBy(period).agg(statistic.alias("_s")).agg(each(0).alias("value_a"), each(1).alias("value_b"))
    return point.join(F.broadcast(ci), F.lit(True)).select("value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("difference"), "low", "high", "n_replicates")  # one row each


def two_proportions(hits_a: str, n_a: str, hits_b: str, n_b: str) -> Column:
    """AG-32. Struct z, p_value, and both with continuity correction; null without variance."""
    a, b, m, n = (F.col(c).cast("double") for c in (hits_a, hits_b, n_a, n_b))
    pool = (a + b) / (m + n)
    se = F.nullif(F.sqrt(pool * (1 - pool) * (1 / m + 1 / n)), F.lit(0.0))
    d = a / m - b / n
    fix = F.greatest(F.abs(d) - (1 / m + 1 / n) / 2, F.lit(0.0)) * F.signum(d)
    two = lambda z: 2 * (1 - normal_cdf(F.abs(z)))
    return F.struct((d / se).alias("z"), two(d / se).alias("p_value"), (fix / se).alias("z_corrected"), two(fix / se).alias("p_corrected"))


def robust_scale(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """AG-33. 1.4826 times the median absolute deviation, or the sample deviation where that is zero.

    Both medians are selected by counting, so a group, or all rows, may be of any size.
    """
    by = by or []
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    centre = quantiles(ok, value, {"_m": 0.5}, by).drop("n")
    apart = beside(ok, centre, by).select("l.*", F.abs(F.col(f"l.{value}") - F.col("r._m")).alias("_d"))
    mad = quantiles(apart, "_d", {"_mad": 0.5}, by).withColumn("_mad", 1.4826 * F.col("_mad"))
    spread = ok.groupBy(*by).agg(F.stddev_samp(value).alias("_sd"))
    scale = F.when(F.col("_mad") > 1e-9, F.col("_mad")).otherwise(F.when(F.col("_sd") > 1e-9, F.col("_sd")))
    return beside(mad, spread, by).select(*(f"l.{c}" for c in by), "l.n", scale.alias("scale"))


def support(df: DataFrame, features: list[str], block: str) -> DataFrame:
    """AG-34. For each block the range of each feature in strictly earlier blocks."""
    per = df.groupBy(block).agg(*(f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.min, "low"), (F.max, "high"))))
    w = Window.orderBy(block).rangeBetween(Window.unboundedPreceding, -1)
    return per.select(block, *((F.min if n == "low" else F.max)(f"{c}_{n}").over(w).alias(f"{c}_{n}") for c in features for n in ("low", "high")))


def support_distance(features: list[str], floor: float = 1e-6) -> Column:
    """AG-34. How far the worst feature lies outside its range, in ranges; null features and unknown ranges don't count."""
    far = []
    for c in features:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        out = F.greatest(low - F.col(c), F.col(c) - high, F.lit(0.0)) / F.greatest(high - low, F.lit(floor))
        far.append(F.when(F.col(c).isNotNull() & low.isNotNull(), out).otherwise(F.lit(0.0)))
    return F.greatest(*far, F.lit(0.0))


def worst(df: DataFrame, p: str, y: str, n: int, tie: list[str]) -> DataFrame:
    """ST-02. The n rows with the highest log loss."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("loss", log_loss(p, y)).orderBy(F.desc("loss"), *tie).limit(n)


def ranked_candidates(table: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """WN-12. A few candidates, numbered in a frozen order of measures and tie-breaks."""
    return table.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def row_accounting(df: DataFrame, status: str, tie: str) -> DataFrame:
    """AG-38. One row: total, scored, warm-up and tied rows, and whether they add up."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col(status) == "FITTED") & ~F.col(tie)).alias("scored"), F.count_if(F.col(status) == "WARMUP").alias("warmup"), F.count_if((F.col(status) == "FITTED") & F.col(tie)).alias("ties"))
    return out.withColumn("balanced", F.col("total") == F.col("scored") + F.col("warmup") + F.col("ties"))


def season_boundaries(ratings: DataFrame, entity: str, season: str, order: str, entering: str, leaving: str, fraction: float, centre: float, tolerance: float = 1e-6) -> DataFrame:
    """WN-10. For each entity's season: how the last one ended, what regression makes of it, how this one began; PASS, FAIL or NO_PRIOR."""
    from tidemark.functions.odds import carried_rating

    ends = ratings.groupBy(entity, season).agg(F.min_by(entering, order).alias("first_value"), F.max_by(leaving, order).alias("last_value"))
    prior = ends.select(entity, (F.col(season) + 1).alias(season), F.col("last_value").alias("prior_value"))
    joined = ends.join(prior, [entity, season], "left").withColumn("expected", carried_rating("prior_value", fraction, centre))
    state = F.when(F.col("prior_value").isNull(), "NO_PRIOR").when(F.abs(F.col("expected") - F.col("first_value")) <= tolerance, "PASS").otherwise("FAIL")
    return joined.select(entity, season, "prior_value", "expected", "first_value", state.alias("state"))
