"""Queries that measure predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import offers, reshape
from tidemark.plans.base import GAMES_SQL, PREDICTIONS_SQL, games, predictions, query, with_
from tidemark.plans.offer_queries import _CDF

_LL = "-ln(case when y = 1 then greatest(1e-15, least(1 - 1e-15, {0})) else 1 - greatest(1e-15, least(1 - 1e-15, {0})) end)"
_SCORES = f"count(*) as n, round(avg(pow(p - y, 2)), 6) as brier, round(avg({_LL.format('p')}), 6) as log_loss, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("brier_logloss", with_(PREDICTIONS_SQL, f"select lang, {_SCORES} from predictions group by lang"))
def brier_logloss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predictions(spark, sf).groupBy("lang").agg(*ev.scores("p", "y")), "brier", "log_loss", "accuracy")


@query("scorecard_grouping_sets", with_(PREDICTIONS_SQL, f"select lang, season, case grouping(lang, season) when 1 then 'lang' when 2 then 'season' else 'ALL' end as grain, {_SCORES} from predictions group by grouping sets ((lang), (season), ())"))
def scorecard_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(offers.summaries(predictions(spark, sf), [["lang"], ["season"], []], ev.scores("p", "y")), "brier", "log_loss", "accuracy")


@query("tie_convention", with_(PREDICTIONS_SQL, "select count(*) as n, round(avg(pow(p - case when tie then 0 else y end, 2)), 6) as brier_tie_zero, round(avg(pow(p - y, 2)) filter (not tie), 6) as brier_tie_null from predictions"))
def tie_convention(spark: SparkSession, sf: str) -> DataFrame:
    df = predictions(spark, sf).withColumns({"z": ev.tie_as_loss("y", "tie"), "x": F.when(~F.col("tie"), F.col("y"))})
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ev.brier("p", "z")), 6).alias("brier_tie_zero"), F.round(F.avg(ev.brier("p", "x")), 6).alias("brier_tie_null"))


_BINS = """b as (select least(cast(floor(p * 10) as int), 9) as bin, count(*) as n, avg(p) as mp, avg(y * 1.0) as o from predictions group by 1), g as (select cast(range as int) as bin from range(10))"""


@query("reliability_bins", with_(PREDICTIONS_SQL, _BINS, "select g.bin, g.bin / 10.0 as low, (g.bin + 1) / 10.0 as high, coalesce(n, 0) as n, round(mp, 6) as mean_p, round(o, 6) as observed, round(mp - o, 6) as gap from g left join b using (bin)").replace("g.bin / 10.0 as low, (g.bin + 1) / 10.0", "cast(g.bin as double) / 10 as low, cast(g.bin + 1 as double) / 10"))
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.reliability_table(predictions(spark, sf), "p", "y"), "mean_p", "observed", "gap")


@query("calibration_error", with_(PREDICTIONS_SQL, _BINS, "select round(sum(n * abs(mp - o)) / sum(n), 6) as ece from b"))
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.expected_calibration_error(ev.reliability_table(predictions(spark, sf), "p", "y")), "ece")


@query("auc_avg_rank", with_(PREDICTIONS_SQL, """r as (select lang, y, rank() over (partition by lang order by p) + (count(*) over (partition by lang, p) - 1) / 2.0 as r from predictions),
    a as (select lang, sum(r) filter (y = 1) as s, count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg from r group by 1)
    select lang, round(case when n_pos > 0 and n_neg > 0 then (s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) end, 6) as auc, n_pos, n_neg from a"""))
def auc_avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.auc(predictions(spark, sf), "p", "y", ["lang"]), "auc")


@query("average_ranks", with_(PREDICTIONS_SQL, "select doc_id, rank() over (order by p2) + (count(*) over (partition by p2) - 1) / 2.0 as r from predictions"))
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return ev.average_rank(predictions(spark, sf), "p2", "r").select("doc_id", "r")


@query("segment_metrics", with_(PREDICTIONS_SQL, "s as (select *, unnest(list_filter([case when week < 4 then 'weeks 0-3' end, case when week >= 4 then 'weeks 4+' end, case when tie then 'post' else 'regular' end, 'full'], lambda x: x is not null)) as segment from predictions)", f"t as (select segment, {_SCORES} from s group by 1) select * from t").replace("),\nt as", "),\nt as"))
def segment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"weeks 0-3": F.col("week") < 4, "weeks 4+": F.col("week") >= 4, "post": F.col("tie"), "regular": ~F.col("tie"), "full": F.lit(True)}
    return rounded(ev.segments(predictions(spark, sf), rules).groupBy("segment").agg(*ev.scores("p", "y")), "brier", "log_loss", "accuracy")


@query("paired_losses", with_(PREDICTIONS_SQL, f"""d as (select lang, pow(p - y, 2) as a, pow(p2 - y, 2) as b, {_LL.format('p2')} - {_LL.format('p')} as l, abs(p2 - p) as c from predictions)
    select lang, count(*) as n, round(avg(a), 6) as brier_a, round(avg(b), 6) as brier_b, round(avg(b - a), 6) as brier_delta, round(avg(l), 6) as log_loss_delta, round(1 - avg(b) / avg(a), 6) as skill, count(*) filter (b < a) as n_better, count(*) filter (b > a) as n_worse, count(*) filter (b = a) as n_equal, round(avg(c), 6) as mean_change, round(median(c), 6) as median_change from d group by 1"""))
def paired_losses(spark: SparkSession, sf: str) -> DataFrame:
    a = predictions(spark, sf)
    out = ev.paired_losses(a, a.select("doc_id", F.col("p2").alias("p")), ["doc_id"], "p", "y", ["lang"])
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


@query("season_stability", with_(PREDICTIONS_SQL, """s as (select season, avg(pow(p2 - y, 2)) - avg(pow(p - y, 2)) as d from predictions group by 1)
    select count(*) filter (d < 0) as n_improved, count(*) filter (d > 0) as n_worsened, min_by(season, d) as strongest, max_by(season, d) as weakest from s"""))
def season_stability(spark: SparkSession, sf: str) -> DataFrame:
    a = predictions(spark, sf)
    per = ev.paired_losses(a, a.select("doc_id", F.col("p2").alias("p")), ["doc_id"], "p", "y", ["season"])
    return ev.season_stability(per, "season", "brier_delta")


@query("regression_scores", with_(GAMES_SQL, """e as (select season, block_ord, home_score * 1.0 as p, away_score * 1.0 as a from games),
    r as (select *, rank() over (partition by season order by p) + (count(*) over (partition by season, p) - 1) / 2.0 as rp, rank() over (partition by season order by a) + (count(*) over (partition by season, a) - 1) / 2.0 as ra from e),
    b as (select season, sqrt(avg(pow(p - a, 2))) as rmse from e group by season, block_ord), s as (select season, stddev_samp(rmse) as sd from b group by 1)
    select season, count(*) as n, round(avg(p - a), 6) as bias, round(avg(abs(p - a)), 6) as mae, round(sqrt(avg(pow(p - a, 2))), 6) as rmse, round(corr(p, a), 6) as pearson, round(corr(rp, ra), 6) as spearman, round(any_value(sd), 6) as block_rmse_std from r join s using (season) group by season"""))
def regression_scores(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf).select("season", "block_ord", F.col("home_score").cast("double").alias("p"), F.col("away_score").cast("double").alias("a"))
    out = ev.regression_scores(g, "p", "a", "block_ord", ["season"])
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


@query("two_prop_z", with_(PREDICTIONS_SQL, f"""s as (select lang, count(*) filter (y = 1 and not tie) * 1.0 as a, count(*) filter (not tie) * 1.0 as m, count(*) filter (y = 1 and tie) * 1.0 as b, count(*) filter (tie) * 1.0 as n from predictions group by 1),
    z as (select lang, a / m - b / n as d, nullif(sqrt((a + b) / (m + n) * (1 - (a + b) / (m + n)) * (1 / m + 1 / n)), 0) as se, greatest(abs(a / m - b / n) - (1 / m + 1 / n) / 2, 0) * sign(a / m - b / n) as f from s where m > 0 and n > 0),
    q as (select lang, d / se as z, f / se as zc from z)
    select lang, round(z, 6) as z, round(2 * (1 - {_CDF.format('abs(z)')}), 6) as p_value, round(zc, 6) as z_corrected, round(2 * (1 - {_CDF.format('abs(zc)')}), 6) as p_corrected from q"""))
def two_prop_z(spark: SparkSession, sf: str) -> DataFrame:
    hit, tie = F.col("y") == 1, F.col("tie")
    s = predictions(spark, sf).groupBy("lang").agg(F.count_if(hit & ~tie).alias("a"), F.count_if(~tie).alias("m"), F.count_if(hit & tie).alias("b"), F.count_if(tie).alias("n")).where("m > 0 and n > 0")
    out = s.select("lang", ev.two_proportions("a", "m", "b", "n").alias("t")).select("lang", "t.*")
    return rounded(out, "z", "p_value", "z_corrected", "p_corrected")


@query("robust_scale", with_(GAMES_SQL, """c as (select season, median(home_score) as m from games group by 1), d as (select season, 1.4826 * median(abs(home_score - m)) as mad, stddev_samp(home_score) as sd, count(*) as n from games join c using (season) group by 1)
    select season, n, round(case when mad > 1e-9 then mad else sd end, 6) as scale from d"""))
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.robust_scale(games(spark, sf), "home_score", ["season"]), "scale")


@query("support_envelope", with_(GAMES_SQL, """b as (select block_ord, min(home_score) as lo, max(home_score) as hi from games group by 1), w as (select block_ord, min(lo) over x as lo, max(hi) over x as hi from b window x as (order by block_ord range between unbounded preceding and 1 preceding))
    select game, round(case when lo is null then 0.0 else greatest(lo - s, s - hi, 0.0) / greatest(hi - lo, 1e-6) end, 6) as distance from (select game, block_ord, home_score + away_score as s from games) g join w using (block_ord)"""))
def support_envelope(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf)
    env = ev.support(g.select("block_ord", F.col("home_score").alias("s")), ["s"], "block_ord")
    out = g.select("game", "block_ord", (F.col("home_score") + F.col("away_score")).alias("s")).join(env, "block_ord")
    return out.select("game", F.round(ev.support_distance(["s"]), 6).alias("distance"))


@query("worst_rows", with_(PREDICTIONS_SQL, f"select doc_id, round({_LL.format('p')}, 6) as loss from predictions order by {_LL.format('p')} desc, doc_id limit 25"))
def worst_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ev.worst(predictions(spark, sf), "p", "y", 25, ["doc_id"]).select("doc_id", F.round("loss", 6).alias("loss"))


@query("row_accounting", with_(PREDICTIONS_SQL, "select count(*) as total, count(*) filter (week >= 2 and not tie) as scored, count(*) filter (week < 2) as warmup, count(*) filter (week >= 2 and tie) as ties, true as balanced from predictions"))
def row_accounting(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf)
    fitted = rows.where("week >= 2").select("doc_id", F.col("p").alias("fit_p"), F.lit(None).cast("string").alias("warmup_reason"))
    return ev.row_accounting(reshape.with_status(rows, fitted, ["doc_id"], "fit_p"), "status", "tie")


@query("candidate_ranking", with_(PREDICTIONS_SQL, """s as (select 'p' as model, avg(pow(p - y, 2)) as b, count(*) as n from predictions union all select 'p2', avg(pow(p2 - y, 2)), count(*) from predictions union all select 'mean', avg(pow((p + p2) / 2 - y, 2)), count(*) from predictions)
    select model, round(b, 6) as brier, cast(row_number() over (order by round(b, 9), model) as int) as place from s"""))
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), c.alias("q")) for m, c in (("p", F.col("p")), ("p2", F.col("p2")), ("mean", (F.col("p") + F.col("p2")) / 2)))))
    s = predictions(spark, sf).select("y", each.alias("e")).select("y", "e.*").groupBy("model").agg(F.avg(ev.brier("q", "y")).alias("b"))
    return ev.ranked_candidates(s, [F.round("b", 9), F.col("model")]).select("model", F.round("b", 6).alias("brier"), "place")


@query("block_bootstrap_ci")
def block_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """AG-31. No SQL: draws come from a hash of counters. Tests hold it against the same draws made in Python."""
    sums = ev.block_sums(predictions(spark, sf), "week", {"l": ev.brier("p2", "y") - ev.brier("p", "y"), "n": F.lit(1)})
    return ev.bootstrap(sums, "week", F.sum("l") / F.sum("n"), seed=11)


@query("row_bootstrap_ci")
def row_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """AG-31 over rows: the interval of the loss difference of two predictions in each language, 10,000 replicates in one pass."""
    rows = predictions(spark, sf)
    return ev.bootstrap_rows(rows, ["doc_id"], {"l": ev.brier("p2", "y") - ev.brier("p", "y"), "n": F.lit(1)}, F.sum("l") / F.sum("n"), replicates=10_000, seed=11, by=["lang"])


@query("global_ranks", with_(GAMES_SQL, f"""e as (select block_ord, home_score + game % 10007 / 10007.0 as p, away_score * 1.0 as a, home_score > away_score as won from games where home <> away),
    r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra from e),
    b as (select sqrt(avg(pow(p - a, 2))) as rmse from e group by block_ord)
    select count(*) as n, round(avg(p - a), 6) as bias, round(avg(abs(p - a)), 6) as mae, round(sqrt(avg(pow(p - a, 2))), 6) as rmse, round(corr(p, a), 6) as pearson, round(corr(rp, ra), 6) as spearman, round((select stddev_samp(rmse) from b), 6) as block_rmse_std,
        round((sum(rp) filter (won) - count(*) filter (won) * (count(*) filter (won) + 1) / 2.0) / (count(*) filter (won) * 1.0 * count(*) filter (not won)), 6) as auc from r"""))
def global_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """AG-24, AG-26 and WN-13 over all rows at once: ranks of as many values as there are games, by a scan over ranges."""
    g = games(spark, sf).where("home <> away").select("block_ord", (F.col("home_score") + F.col("game") % 10007 / F.lit(10007.0)).alias("p"), F.col("away_score").cast("double").alias("a"), (F.col("home_score") > F.col("away_score")).cast("int").alias("won"))
    both = ev.regression_scores(g, "p", "a", "block_ord").join(F.broadcast(ev.auc(g, "p", "won").select("auc")), F.lit(True))  # one row each
    return rounded(both, *(c for c, t in both.dtypes if t == "double"))


@query("global_quantiles", """select count(*) as n, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.9), 6) as p90, round(quantile_cont(l_extendedprice, 0.001), 6) as low from lineitem""")
def global_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """AG-17: exact quantiles of all rows."""
    from tidemark.operators.scan import quantiles
    from tidemark.plans.base import load

    out = quantiles(load(spark, sf, "lineitem"), "l_extendedprice", {"median": 0.5, "p90": 0.9, "low": 0.001})
    return rounded(out, "median", "p90", "low")


@query("global_scale", with_(GAMES_SQL, """c as (select median(home_score) as m from games), d as (select 1.4826 * median(abs(home_score - m)) as mad, stddev_samp(home_score) as sd, count(*) as n from games, c)
    select n, round(case when mad > 1e-9 then mad else sd end, 6) as scale from d"""))
def global_scale(spark: SparkSession, sf: str) -> DataFrame:
    """AG-33 over all rows."""
    return rounded(ev.robust_scale(games(spark, sf), "home_score"), "scale")
