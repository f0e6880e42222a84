"""Queries with fitted or folded state; SQL cannot say them, so tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.functions import Rating
from tidemark.models import fits, ratings
from tidemark.operators import blocks, offers
from tidemark.operators import evaluation as ev
from tidemark.operators.scan import running
from tidemark.plans import pipelines
from tidemark.plans.base import games, predictions, query, quotes
from tidemark.plans.landing_queries import leagues, leagues_sql


#: Shares of a rating's distance to the start that a new season takes away. Fixed values.
_CARRY = {f"carry {c}": c for c in (0.0, 0.25, 0.4, 0.6, 0.333)}


@query("rating_fold", "with recursive " + leagues_sql(_CARRY) + """ select config, league, k as block_ord, season, game, s.side, case s.side when 'home' then 'e' || (h - 1) else 'f' || (a - 6) end as entity, case s.side when 'home' then 'f' || (a - 6) else 'e' || (h - 1) end as other,
    round(case s.side when 'home' then bh else ba end, 6) as before, round(case s.side when 'home' then p else 1 - p end, 6) as p, case when m > 0 then case s.side when 'home' then 1.0 else 0.0 end when m < 0 then case s.side when 'home' then 0.0 else 1.0 end when m = 0 then 0.5 end as actual,
    round(case s.side when 'home' then d else -d end, 6) as change, round(case s.side when 'home' then bh + d else ba - d end, 6) as after from fold, (values ('home'), ('away')) s(side) where k > 0""")
def rating_fold(spark: SparkSession, sf: str) -> DataFrame:
    """ML-01, ML-02. Every league's games under three shares that are carried back."""
    out = ratings.rating_ledger(leagues(spark, sf), {name: Rating(carry_back=c) for name, c in _CARRY.items()})
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return out.select("config", "league", "block_ord", "season", "game", "side", "entity", "other", r("before"), r("p"), "actual", r("change"), r("after"))


@query("season_boundary_audit", "with recursive " + leagues_sql({"x": 1 / 3}) + """, l as (select league || '/' || case s.side when 'home' then 'e' || (h - 1) else 'f' || (a - 6) end as who, season, k, case s.side when 'home' then bh else ba end as before, case s.side when 'home' then bh + d else ba - d end as after from fold, (values ('home'), ('away')) s(side) where k > 0),
    e as (select who, season, arg_min(before, k) as first_value, arg_max(after, k) as last_value from l group by 1, 2)
    select e.who, e.season, round(q.last_value, 6) as prior_value, round(q.last_value + (1500 - q.last_value) / 3, 6) as expected, round(e.first_value, 6) as first_value,
        case when q.who is null then 'NO_PRIOR' when abs(q.last_value + (1500 - q.last_value) / 3 - e.first_value) <= 1e-6 then 'PASS' else 'FAIL' end as state from e left join e q on q.who = e.who and q.season = e.season - 1""")
def season_boundary_audit(spark: SparkSession, sf: str) -> DataFrame:
    """WN-10."""
    rows = ratings.rating_ledger(leagues(spark, sf), {"carry": Rating()}).withColumn("who", F.concat_ws("/", "league", "entity"))
    out = ev.season_boundaries(rows, "who", "season", "block_ord", "before", "after", 1 / 3, 1500.0)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("prior_value", "expected", "first_value")})


@query("recalibration")
def recalibration(spark: SparkSession, sf: str) -> DataFrame:
    return fits.recalibration(predictions(spark, sf), "p", "y", ["lang"])


def _panel(spark: SparkSession, sf: str) -> tuple[DataFrame, blocks.Prior]:
    """All games with their place in time, and the months before each month."""
    g = running(games(spark, sf).where("home <> away"), [], ["day", "game"], {"game_ord": F.lit(1)})
    return g, blocks.prior_nodes(g.select("block_ord").distinct())


#: Games until a result weighs half; about a month of them at scale factor 0.01.
HALF_LIFE = 180.0


@query("block_ridge")
def block_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """ML-04, ML-05: every game's expected points by the months before it."""
    g, prior = _panel(spark, sf)
    effects = fits.ridge_effects(g, prior, half_life=HALF_LIFE)
    return fits.expected_points(g, effects).select("game", "block_ord", "expected_home", "expected_away", "expected_margin")


@query("margin_chain")
def margin_chain(spark: SparkSession, sf: str) -> DataFrame:
    """ML-07: every game's expected margin, and its chance by the map of earlier out-of-sample margins."""
    g, prior = _panel(spark, sf)
    return fits.margin_chain(g, prior, HALF_LIFE).select("game", "block_ord", "expected_margin", "p_home", "status")


@query("margin_maps")
def margin_maps(spark: SparkSession, sf: str) -> DataFrame:
    """ML-06: for each month the map from the margins of a score model to results."""
    g, prior = _panel(spark, sf)
    rows = fits.expected_points(g, fits.ridge_effects(g, prior, half_life=HALF_LIFE)).withColumn("y", F.when(F.col("home_score") != F.col("away_score"), (F.col("home_score") > F.col("away_score")).cast("int")))
    return fits.margin_maps(rows, prior, "expected_margin", "y")


def _priced(spark: SparkSession, sf: str) -> tuple[DataFrame, blocks.Prior]:
    """All quotes by month, with a model's probability and whether the bet won (null on a push)."""
    q = quotes(spark, sf).withColumns({"block_ord": (F.col("season") - 1990) * 12 + F.col("month"), "settled": fn.settlement("market", "side", "line", "home_score", "away_score")})
    rows = q.withColumns({"y": F.when(F.col("settled") == "WIN", 1).when(F.col("settled") == "LOSS", 0), "g": (F.col("game") % 89 + 5).cast("double"), "p_market": fn.break_even("price")})
    return rows.withColumn("p_model", F.col("g") / 100), blocks.prior_nodes(rows.select("block_ord").distinct())


@query("pooled_fit")
def pooled_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows, prior = _priced(spark, sf)
    return fits.pooled(rows, fits.pooling(rows, prior, "p_model", "p_market", "y"), "p_model", "p_market").select("l_orderkey", "l_linenumber", "block_ord", "p_pooled")


@query("point_fits")
def point_fits(spark: SparkSession, sf: str) -> DataFrame:
    """ML-10 over all spreads and totals, each side's line as the home side's or over's."""
    rows, prior = _priced(spark, sf)
    total, first = F.col("market") == "total", F.col("side").isin("home", "over")
    at = F.when(total, F.col("line")).when(first, -F.col("line")).otherwise(F.col("line"))
    actual = F.when(total, F.col("home_score") + F.col("away_score")).otherwise(F.col("home_score") - F.col("away_score"))
    lined = rows.where("market <> 'moneyline'").withColumns({"at": at, "actual": actual, "m": at + F.col("g") / 10 - 5, "p_above": F.when(first, F.col("p_market")).otherwise(1 - F.col("p_market"))})
    return fits.point_fits(lined, prior, "m", "at", "p_above", "actual")


@query("ridge_panel")
def ridge_panel(spark: SparkSession, sf: str) -> DataFrame:
    g, prior = _panel(spark, sf)
    rows = g.withColumns({"x1": (F.col("game") % 17).cast("double"), "x2": F.when(F.col("game") % 5 != 0, (F.col("away_score") % 13).cast("double"))})
    out = fits.ridge_panel(rows, prior, ["x1", "x2"], ["priority"], "home_score", [1.0, 100.0], ["game"])
    return ev.regression_scores(out, "predicted", "actual", "target", ["alpha"])


def _board(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).withColumn("block_ord", (F.col("season") - 1990) * 12 + F.col("month"))
    # a game is a part in a month
    q = q.withColumn("game", F.col("game") * 1000 + F.col("block_ord"))
    ids = q.select("game", "home_score", "away_score").distinct()
    part = lambda k: ((F.col("game") * k % 83 + 5 + F.col("game") % 7) / 100.0)
    models = ids.select("game", part(1).alias("p_home_a"), part(11).alias("p_home_b"), ((part(1) + part(11)) / 2).alias("p_home"), (F.col("home_score") - F.col("away_score") + F.col("game") % 15 - 7).cast("double").alias("margin"), (F.col("home_score") + F.col("away_score") + F.col("game") % 11 - 5).cast("double").alias("total"))
    return pipelines.offer_board(q, models, ["b3", "b0"])


@query("offer_board")
def offer_board(spark: SparkSession, sf: str) -> DataFrame:
    """PL-09, ML-13, ML-14: every best offer of all markets and sides by month."""
    return _board(spark, sf)


@query("reliability_states")
def reliability_states(spark: SparkSession, sf: str) -> DataFrame:
    losses = predictions(spark, sf).select(F.col("week").alias("block_ord"), (F.col("p") - F.col("y")).alias("gap"))
    return fits.reliability_states(losses, least_rows=20)


@query("boosted_panel")
def boosted_panel(spark: SparkSession, sf: str) -> DataFrame:
    """ML-12: every prediction's row, weeks in order; the first weeks are warm-up."""
    df = predictions(spark, sf).withColumn("block_ord", F.col("week").cast("int"))
    return fits.boosted_panel(df, ["p", "p2", "season"], "y", least_validation=10, least_fit=16).select("doc_id", "block_ord", F.col("p_boosted").alias("p"), "status", "warmup_reason")


@query("evaluated_summary")
def evaluated_summary(spark: SparkSession, sf: str) -> DataFrame:
    """PL-09: the offer board summed up by market, tier and status."""
    b = _board(spark, sf)
    price = fn.american_to_decimal("price")
    profit = F.when(F.col("settled") == "WIN", price - 1).when(F.col("settled") == "LOSS", -1.0).otherwise(0.0)
    return offers.summaries(b.withColumns({"profit": profit, "price_decimal": price}), [["market", "tier", "status"], ["market"], []], offers.summary())
