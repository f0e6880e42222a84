"""Queries over time: boundaries, as-of picks, running state, blocks, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import block_label, boundary_after, boundary_before, weekly_availability
from tidemark.operators import asof, blocks, events, history, reshape
from tidemark.plans.base import GAMES_SQL, PLAYS_SQL, games, load, plays, query, with_

_BEFORE = "{0} - cast((dayofweek({0}) + 4) % 7 + 1 as int)"
_AFTER = "{0} + cast((8 - dayofweek({0})) % 7 + 1 as int)"
_NOON = "epoch_us(cast({} as timestamp) + interval 12 hour)"
before_sql, after_sql = (lambda d: _NOON.format(_BEFORE.format(d))), (lambda d: _NOON.format(_AFTER.format(d)))


def _micros(c: str):
    return F.unix_micros(c).alias(c)


@query("weekly_boundaries", f"""
    with e as (select cast(date_trunc('week', ts) as date) as week, cast(ts as date) as day from events)
    select cast(week as varchar) as week, cast(min(day) as varchar) as first_day, cast(max(day) as varchar) as last_day, {before_sql('min(day)')} as as_of, {after_sql('max(day)')} as available_at, 'COMPLETE' as quality
    from e group by week""")
def weekly_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.to_date("ts").alias("day"))
    out = weekly_availability(e, ["week"], "day")
    return out.select(F.col("week").cast("string"), F.col("first_day").cast("string"), F.col("last_day").cast("string"), _micros("as_of"), _micros("available_at"), "quality")


_EVENTS_SQL = f"""f as (select user_id, event_id, value, ts, {after_sql('cast(ts as date)')} as available_at from events),
    t as (select user_id, cast(date_trunc('week', ts) as date) as week, {before_sql('min(cast(ts as date))')} as as_of from events group by 1, 2)"""


def _event_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf, "events").select("user_id", "event_id", "value", "ts", "event_type")
    facts = e.withColumn("available_at", boundary_after(F.to_date("ts")))
    targets = e.groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(boundary_before(F.min(F.to_date("ts"))).alias("as_of"))
    return facts, targets


@query("asof_lastk", with_(_EVENTS_SQL, """r as (select t.user_id, t.week, f.value, row_number() over (partition by t.user_id, t.week order by f.available_at desc, f.ts desc, f.event_id desc) as k
        from t join f on f.user_id = t.user_id and f.available_at <= t.as_of),
    a as (select user_id, week, avg(value) as m, sum(value) as s, case when count(*) >= 2 then stddev_pop(value) end as d, count(*) as n from r where k <= 4 group by 1, 2)
    select t.user_id, cast(t.week as varchar) as week, round(a.m, 6) as roll4_mean, round(a.s, 6) as roll4_sum, round(a.d, 6) as roll4_std, coalesce(a.n, 0) as roll4_n,
           round(coalesce(a.m, 10.0), 6) as value_filled, a.n is null as value_filled_missing, a.m is null as value_filled_imputed
    from t left join a using (user_id, week)"""))
def asof_lastk(spark: SparkSession, sf: str) -> DataFrame:
    facts, targets = _event_facts(spark, sf)
    rolled = asof.rolled(facts, ["user_id"], ["available_at", "ts", "event_id"], ["value"], [4])
    picked = asof.asof(targets, rolled, ["user_id"], "as_of", "available_at", [f"roll4_value_{x}" for x in ("mean", "sum", "std", "n")], ["ts", "event_id"])
    r = lambda c: F.round(c, 6)
    filled = history.with_prior("roll4_value_mean", 10.0, "roll4_value_n", "value_filled")
    out = picked.select("user_id", F.col("week").cast("string").alias("week"), r("roll4_value_mean").alias("roll4_mean"), r("roll4_value_sum").alias("roll4_sum"), r("roll4_value_std").alias("roll4_std"), F.coalesce("roll4_value_n", F.lit(0)).alias("roll4_n"), *filled)
    return out.withColumn("value_filled", r("value_filled"))


_ORDERS_SQL = "o as (select o_custkey, o_orderkey, o_totalprice as price, cast(o_orderdate as date) as day, year(o_orderdate) as season from orders)"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"))


@query("asof_season_to_date", with_(_ORDERS_SQL, """t as (select o_custkey, o_orderkey, season, day from o)
    select t.o_orderkey, count(f.o_orderkey) as std_n, round(avg(f.price), 4) as std_mean, round(sum(f.price), 2) as std_sum
    from t left join o f on f.o_custkey = t.o_custkey and f.season = t.season and f.day < t.day group by 1"""))
def asof_season_to_date(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    facts = asof.season_to_date(o, ["o_custkey"], "season", ["day", "o_orderkey"], ["price"]).withColumn("usable", F.date_add("day", 1))
    targets = o.select("o_custkey", "o_orderkey", "season", "day")
    out = asof.asof(targets, facts.select("o_custkey", "season", "usable", F.col("o_orderkey").alias("_k"), "std_n", "std_price_mean", "std_price_sum"), ["o_custkey", "season"], "day", "usable", ["std_n", "std_price_mean", "std_price_sum"], ["_k"])
    return out.select("o_orderkey", F.coalesce("std_n", F.lit(0)).alias("std_n"), F.round("std_price_mean", 4).alias("std_mean"), F.round("std_price_sum", 2).alias("std_sum"))


@query("carryover_roll", with_(_ORDERS_SQL, """h as (select t.o_orderkey, t.season as ts, f.season as fs, f.price, row_number() over (partition by t.o_orderkey order by f.day desc, f.o_orderkey desc) as k
        from o t join o f on f.o_custkey = t.o_custkey and f.day < t.day),
    c as (select o_orderkey, count(*) filter (fs = ts) as c from h group by 1),
    u as (select h.o_orderkey, c, avg(price) filter (case when c < 3 then k <= least(4, 4 + c) else fs = ts and k <= 4 end) as r4,
          avg(price) filter (case when c < 3 then k <= least(8, 4 + c) else fs = ts and k <= 8 end) as r8 from h join c using (o_orderkey) group by 1, 2)
    select o.o_orderkey, coalesce(c, 0) as season_n, round(r4, 4) as roll4, round(r8, 4) as roll8 from o left join u using (o_orderkey)"""))
def carryover_roll(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    facts = o.select("o_custkey", "season", "price", F.date_add("day", 1).alias("usable"), F.col("o_orderkey").alias("_key"))
    out = asof.carried_rolls(o.select("o_custkey", "o_orderkey", "season", "day"), facts, ["o_custkey"], "season", "day", "usable", "price", ["_key"])
    return out.select("o_orderkey", "season_n", F.round("roll4", 4).alias("roll4"), F.round("roll8", 4).alias("roll8"))


@query("shrunk_rate", """with u as (select user_id, count(*) as n, sum(case when event_type = 'purchase' then 1 else 0 end) as k, sum(value * greatest(value, 1)) / sum(greatest(value, 1)) as wm from events group by 1)
    select user_id, n, round(k / n, 6) as rate, round(n / (n + 50.0) * (k / n) + 50.0 / (n + 50.0) * 0.2, 6) as shrunk_rate, round(wm, 6) as weighted from u""")
def shrunk_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    u = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("k"), history.weighted_mean("value", "value").alias("wm"))
    return u.select("user_id", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(history.shrunk(F.col("k") / F.col("n"), "n", 0.2, 50.0), 6).alias("shrunk_rate"), F.round("wm", 6).alias("weighted"))


@query("recency_weighted", with_(_ORDERS_SQL, """r as (select t.o_orderkey, f.price, row_number() over (partition by t.o_orderkey order by f.day desc, f.o_orderkey desc) as k
        from o t join o f on f.o_custkey = t.o_custkey and (f.day, f.o_orderkey) <= (t.day, t.o_orderkey))
    select o_orderkey, round(sum(price * pow(0.7, k - 1)) / sum(pow(0.7, k - 1)), 4) as recency from r where k <= 4 group by 1"""))
def recency_weighted(spark: SparkSession, sf: str) -> DataFrame:
    out = history.recency_mean(_orders(spark, sf), ["o_custkey"], ["day", "o_orderkey"], "price", 4, 0.7, "recency")
    return out.select("o_orderkey", F.round("recency", 4).alias("recency"))


@query("completed_age", with_(_ORDERS_SQL, "select o_orderkey, count(*) over (partition by o_custkey order by day, o_orderkey rows between 1 following and unbounded following) as age, round(pow(0.5, count(*) over (partition by o_custkey order by day, o_orderkey rows between 1 following and unbounded following) / 8.0), 6) as weight from o"))
def completed_age(spark: SparkSession, sf: str) -> DataFrame:
    out = history.completed_age(_orders(spark, sf), ["day", "o_orderkey"], F.lit(True), ["o_custkey"])
    return out.select("o_orderkey", "age", F.round(history.half_life_weight("age", 8.0), 6).alias("weight"))


FLAGS_SQL = """v as (select *, coalesce(play_deleted = 0 and aborted_play = 0 and posteam is not null and defteam is not null and play_type in ('pass', 'run', 'qb_kneel', 'qb_spike'), false) as is_valid from plays),
    fl as (select *, is_valid and pass_attempt = 1 as is_pass, is_valid and rush_attempt = 1 and qb_kneel = 0 as is_rush,
           is_valid and (case when qb_dropback is null then pass_attempt = 1 or sack = 1 else qb_dropback = 1 end) as is_dropback from v),
    fs as (select *, is_pass and complete_pass = 1 as is_completion, is_pass and interception = 1 or is_valid and fumble_lost = 1 as is_turnover,
           is_valid and coalesce(qtr in (1, 2, 3) and abs(score_differential) <= 8 and game_seconds_remaining >= 900, false) as is_neutral from fl)"""


@query("event_flags", with_(PLAYS_SQL, FLAGS_SQL, """n as (select game, count(*) filter (is_valid) as n_valid, count(*) filter (is_pass) as n_pass, count(*) filter (is_completion) as n_completion, count(*) filter (is_rush) as n_rush,
        count(*) filter (is_dropback) as n_dropback, count(*) filter (is_dropback and qb_dropback is null) as n_fallback, count(*) filter (is_turnover) as n_turnover, count(*) filter (is_valid and epa is not null) as n_epa, count(*) filter (is_valid and success is not null) as n_success,
        count(*) filter (is_pass and air_yards is not null) as n_air, count(*) filter (is_completion and yards_after_catch is not null) as n_yac, count(*) filter (is_valid and yards_gained is not null) as n_yards,
        count(*) filter (is_pass and yards_gained >= 20) as n_explosive_pass, count(*) filter (is_rush and yards_gained >= 10) as n_explosive_rush, count(*) filter (is_valid and yardline_100 <= 20) as n_red_zone, count(*) filter (is_valid and goal_to_go = 1) as n_goal,
        count(*) filter (is_neutral) as n_neutral from fs group by game)
    select * from n"""))
def event_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = events.play_flags(plays(spark, sf))
    n = {"n_valid": "is_valid", "n_pass": "is_pass", "n_completion": "is_completion", "n_rush": "is_rush", "n_dropback": "is_dropback", "n_fallback": "is_dropback_fallback", "n_turnover": "is_turnover", "n_epa": "has_epa", "n_success": "has_success",
         "n_air": "has_air_yards", "n_yac": "has_yac", "n_yards": "has_yards", "n_explosive_pass": "is_explosive_pass", "n_explosive_rush": "is_explosive_rush", "n_red_zone": "in_red_zone", "n_goal": "is_goal_to_go", "n_neutral": "is_neutral"}
    return p.groupBy("game").agg(*(F.count_if(c).alias(k) for k, c in n.items()))


@query("game_triples", with_(PLAYS_SQL, FLAGS_SQL, """l as (select game, posteam, 'epa' as metric, coalesce(sum(epa) filter (is_valid), 0) as num, count(epa) filter (is_valid) * 1.0 as den, count(epa) filter (is_valid) as n from fs where posteam is not null group by 1, 2
        union all select game, posteam, 'yards', coalesce(sum(yards_gained) filter (is_rush), 0), coalesce(sum(2.0) filter (is_rush), 0), count(*) filter (is_rush) from fs where posteam is not null group by 1, 2)
    select posteam, metric, round(sum(num), 6) as num, cast(sum(den) as double) as den, cast(sum(n) as bigint) as n from l group by 1, 2"""))
def game_triples(spark: SparkSession, sf: str) -> DataFrame:
    p = events.play_flags(plays(spark, sf)).where("posteam is not null")
    long = events.triples(p, ["game", "posteam"], {"epa": events.Metric(F.col("is_valid"), F.col("epa")), "yards": events.Metric(F.col("is_rush"), F.col("yards_gained"), F.lit(2.0))})
    return long.groupBy("posteam", "metric").agg(F.round(F.sum("num"), 6).alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"))


_LONG_SQL = """long as (select game, home as entity, 'points' as metric, home_score * 1.0 as num, 1.0 as den, 1 as n from games union all select game, away, 'points', away_score * 1.0, 1.0, 1 from games),
    mirror as (select l.game, entity, metric, num, den, n from long l union all select l.game, case when l.entity = g.home then g.away else g.home end, metric || '_allowed', num, den, n from long l join games g using (game))"""


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = games(spark, sf)
    long = reshape.two_sided(g, {"entity": "home", "score": "home_score"}, {"entity": "away", "score": "away_score"}, ["game"])
    long = long.select("game", "entity", F.lit("points").alias("metric"), F.col("score").cast("double").alias("num"), F.lit(1.0).alias("den"), F.lit(1).cast("long").alias("n"))
    return g, events.mirrored(long, g, "game", "entity")


@query("mirror_metrics", with_(GAMES_SQL, _LONG_SQL, "select entity, metric, sum(num) as num, sum(den) as den, cast(sum(n) as bigint) as n from mirror group by 1, 2").replace("sum(num) as num, sum(den) as den", "cast(sum(num) as double) as num, cast(sum(den) as double) as den"))
def mirror_metrics(spark: SparkSession, sf: str) -> DataFrame:
    _, m = _points(spark, sf)
    return m.groupBy("entity", "metric").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("n").alias("n"))


@query("two_sided_expand", with_(GAMES_SQL, "select game, 'home' as side, home as entity, home_score as score from games union all select game, 'away', away, away_score from games"))
def two_sided_expand(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.two_sided(games(spark, sf), {"entity": "home", "score": "home_score"}, {"entity": "away", "score": "away_score"}, ["game"])


@query("wide_sides", with_(GAMES_SQL, "select game, home as home_entity, home_score, away as away_entity, away_score from games"))
def wide_sides(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.wide_sides(two_sided_expand(spark, sf), ["game"], "side", ["home", "away"], ["entity", "score"])


@query("entering_state", with_(GAMES_SQL, _LONG_SQL, """b as (select entity, metric, block_ord, sum(num) as num, sum(den) as den, sum(n) as n from mirror join games using (game) group by 1, 2, 3)
    select entity, metric, block_ord, cast(coalesce(sum(num) over w, 0) as double) as num, cast(coalesce(sum(den) over w, 0) as double) as den, cast(coalesce(sum(n) over w, 0) as bigint) as n
    from b window w as (partition by entity, metric order by block_ord range between unbounded preceding and 1 preceding)"""))
def entering_state(spark: SparkSession, sf: str) -> DataFrame:
    g, m = _points(spark, sf)
    return history.entering_state(m.join(g.select("game", "block_ord"), "game"), ["entity", "metric"])


@query("matchup_mean", with_(GAMES_SQL, _LONG_SQL, """b as (select entity, metric, block_ord, sum(num) as num, sum(den) as den from mirror join games using (game) group by 1, 2, 3),
    s as (select g.game, x.side, b.metric, sum(b.num) as num, sum(b.den) as den from games g, lateral (select 'home' as side, g.home as e union all select 'away', g.away) x
          join b on b.entity = x.e and b.block_ord < g.block_ord group by 1, 2, 3),
    r as (select game, max(case when side = 'home' and metric = 'points' and den >= 20 then num / den end) as hp, max(case when side = 'home' and metric = 'points_allowed' and den >= 20 then num / den end) as ha,
          max(case when side = 'away' and metric = 'points' and den >= 20 then num / den end) as ap, max(case when side = 'away' and metric = 'points_allowed' and den >= 20 then num / den end) as aa from s group by 1)
    select g.game, round((hp + aa) / 2, 6) as home_points, round((ap + ha) / 2, 6) as away_points from games g left join r using (game)"""))
def matchup_mean(spark: SparkSession, sf: str) -> DataFrame:
    g, m = _points(spark, sf)
    states = history.leaving_state(m.join(g.select("game", "block_ord"), "game"), ["entity", "metric"])
    out = history.matchups(g.select("game", "home", "away", "block_ord"), states, {"points": ("points", "points_allowed", 20.0)})
    return out.select("game", F.round("home_points", 6).alias("home_points"), F.round("away_points", 6).alias("away_points"))


@query("week_gaps", with_(_ORDERS_SQL, """p as (select o_orderkey, datediff('day', date '1990-01-01', day) // 7 as week, lag(datediff('day', date '1990-01-01', day) // 7) over (partition by o_custkey, season order by day, o_orderkey) as last_week from o)
    select o_orderkey, week - last_week as week_gap, coalesce(week - last_week > 1, false) as after_bye from p"""))
def week_gaps(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).withColumn("week", F.floor(F.datediff("day", F.lit("1990-01-01").cast("date")) / 7))
    w = Window.partitionBy("o_custkey", "season").orderBy("day", "o_orderkey")
    return asof.week_gap(o.withColumn("last_week", F.lag("week").over(w)), "week", "last_week").select("o_orderkey", "week_gap", "after_bye")


@query("consecutive_intervals", """with e as (select event_id, user_id, cast(ts as date) as day, epoch_us(ts) / 1e6 as s, event_type from events where event_type <> 'error'),
    g as (select *, s - lag(s) over w as seconds, event_type = lag(event_type) over w as same from e window w as (partition by user_id, day order by s, event_id))
    select event_id, round(seconds, 3) as seconds, coalesce(seconds > 0 and seconds <= 7200 and same, false) as valid_interval from g""")
def consecutive_intervals(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").where("event_type <> 'error'").select("event_id", "user_id", F.to_date("ts").alias("day"), (F.unix_micros("ts") / 1e6).alias("s"), "event_type")
    out = events.intervals(e, ["user_id", "day"], ["s", "event_id"], "s", ["event_type"], longest=7200.0, falling=False)
    return out.select("event_id", F.round("seconds", 3).alias("seconds"), "valid_interval")


@query("possession_rollup", with_(PLAYS_SQL, """p as (select game, drive, min_by(result, play_id) filter (result is not null) as result, count(distinct result) as n_results, count(*) filter (pass_attempt = 1) as n_pass, count(*) as n_plays from plays group by 1, 2)
    select *, case result when 'Touchdown' then 7 when 'Field goal' then 3 end as points, coalesce(result in ('Touchdown', 'Field goal'), false) as scored, n_results > 1 as conflict from p"""))
def possession_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = events.possessions(plays(spark, sf), ["game", "drive"], "play_id", "result", {"n_pass": F.col("pass_attempt") == 1})
    return out.withColumn("conflict", F.col("n_results") > 1)


@query("opportunity_any", with_(PLAYS_SQL, "select game, drive, bool_or(yardline_100 <= 20) as red_zone, bool_or(goal_to_go = 1) as goal_to_go from plays group by 1, 2"))
def opportunity_any(spark: SparkSession, sf: str) -> DataFrame:
    return events.opportunities(plays(spark, sf), ["game", "drive"], {"red_zone": F.col("yardline_100") <= 20, "goal_to_go": F.col("goal_to_go") == 1})


@query("strict_recode", "select event_id, case event_type when 'view' then 1 when 'signup' then 2 when 'error' then 3 when 'click' then 4 when 'purchase' then 5 end as code from events")
def strict_recode(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions import strict_recode as recode

    return load(spark, sf, "events").select("event_id", recode("event_type", {"view": 1, "signup": 2, "error": 3, "click": 4, "purchase": 5}).alias("code"))


@query("anchored_clusters", """with recursive e as (select user_id, cast(ts as date) as day, epoch_us(ts) as t, event_id, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as k from events),
    c as (select user_id, day, k, t, t as start from e where k = 1 union all
          select e.user_id, e.day, e.k, e.t, case when e.t - c.start <= 7200000000 then c.start else e.t end from c join e on e.user_id = c.user_id and e.day = c.day and e.k = c.k + 1)
    select user_id, cast(day as varchar) as day, start, count(*) as n from c group by 1, 2, 3""")
def anchored_clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    out = blocks.anchored_clusters(e, ["user_id", "day"], "ts", 120, "event_id")
    return out.select("user_id", F.col("day").cast("string").alias("day"), F.unix_micros("cluster_start").alias("start"), F.col("n").cast("long").alias("n"))


@query("block_schedule", with_(GAMES_SQL, "select season, month, season || '-W' || lpad(cast(month as varchar), 2, '0') as label, count(*) as n_ids, min(game) as first_id, cast(row_number() over (order by season, month) - 1 as int) as block_ord from games group by season, month"))
def block_schedule(spark: SparkSession, sf: str) -> DataFrame:
    out = blocks.schedule(games(spark, sf), ["season", "month"], "game")
    return out.select("season", "month", block_label("season", "month").alias("label"), "n_ids", F.col("ids")[0].alias("first_id"), "block_ord")


_BLOCKS_SQL = "bl as (select season, month, cast(row_number() over (order by season, month) - 1 as int) as block_ord, min(day) as first_day, max(day) as last_day from games group by season, month)"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    per = games(spark, sf).groupBy("season", "month").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return blocks.numbered(per, ["season", "month"]).withColumns({"as_of": boundary_before("first_day"), "available_at": boundary_after("last_day")})


@query("prior_block_pairs", with_(GAMES_SQL, _BLOCKS_SQL, f"select t.block_ord as target, s.block_ord as source from bl t join bl s on s.block_ord < t.block_ord and {after_sql('s.last_day')} <= {before_sql('t.first_day')}"))
def prior_block_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.prior_pairs(_blocks(spark, sf), as_of="as_of", available_at="available_at")


@query("expanding_panel", with_(GAMES_SQL, _BLOCKS_SQL, "select t.block_ord as target, count(*) as n, cast(sum(home_score) as bigint) as points from bl t join bl s on s.block_ord < t.block_ord join games g on g.season = s.season and g.month = s.month group by 1"))
def expanding_panel(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    rows = blocks.with_block(games(spark, sf).drop("block_ord"), b, ["season", "month"])
    # sums of blocks, paired as blocks: rows are never expanded
    per = rows.groupBy("block_ord").agg(F.count(F.lit(1)).alias("n"), F.sum("home_score").alias("points"))
    return blocks.panel(per, blocks.prior_pairs(b)).groupBy("target").agg(F.sum("n").alias("n"), F.sum("points").alias("points"))


_EXPOSURE_SQL = """x as (select b.block_ord, count(g.game) as n, count(g.game) filter (g.home_score > 0) as done, min(g.season) as lo, max(g.season) as hi from bl b join games g on g.season = b.season and g.month = b.month group by 1),
    ex as (select block_ord, cast(coalesce(sum(n) over w, 0) as bigint) as prior_rows, cast(coalesce(sum(done) over w, 0) as bigint) as prior_completed, count(n) over w as prior_blocks, min(lo) over w as first_season, max(hi) over w as last_season
           from x window w as (order by block_ord range between unbounded preceding and 1 preceding))"""


def _exposure(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    return blocks.exposure(blocks.with_block(games(spark, sf).drop("block_ord"), b, ["season", "month"]), b, F.col("home_score") > 0, "season")


@query("exposure_counts", with_(GAMES_SQL, _BLOCKS_SQL, _EXPOSURE_SQL, "select * from ex"))
def exposure_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _exposure(spark, sf)


@query("fit_val_split", with_(GAMES_SQL, """p as (select block_ord as b, count(*) filter (home_score > 0 and game % 7 > 0) as n from games group by 1), k as (select * from p where n > 0),
    t as (select p.b, coalesce(list(k.b order by k.b desc) filter (k.b is not null), []) as bs, coalesce(list(k.n order by k.b desc) filter (k.b is not null), []) as ns from p left join k on k.b < p.b group by 1),
    w as (select b, bs, case when len(bs) < 2 then 'too_few_validation_blocks' when list_sum(ns[1:2]) < 21 then 'too_few_validation_rows' when len(bs) < 4 then 'too_few_fit_blocks' when list_sum(ns[3:]) < 32 then 'too_few_fit_rows' end as warmup_reason from t)
    select b as block_ord, case when warmup_reason is null then bs[3] end as fit_last, case when warmup_reason is null then bs[2] end as validate_first, case when warmup_reason is null then bs[1] end as validate_last, warmup_reason from w"""))
def fit_val_split(spark: SparkSession, sf: str) -> DataFrame:
    """WN-15."""
    return blocks.fit_split(games(spark, sf), (F.col("home_score") > 0) & (F.col("game") % 7 > 0))


@query("expanding_cells", with_(GAMES_SQL, "b as (select block_ord, home_score as cell, count(*) as n, sum(away_score) as points from games group by 1, 2), t as (select distinct block_ord as target from games) select target, cell, cast(sum(n) as bigint) as n, cast(sum(points) as bigint) as points from t join b on b.block_ord < t.target group by 1, 2"))
def expanding_cells(spark: SparkSession, sf: str) -> DataFrame:
    """JN-05, WN-16 over a long calendar: counts by score of all earlier months, by nodes of a tree of months."""
    g = games(spark, sf)
    per = g.groupBy("block_ord", F.col("home_score").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("away_score").alias("points"))
    return blocks.prior_sums(per, blocks.prior_nodes(g.select("block_ord").distinct()), ["cell"], ["n", "points"])


@query("latest_rows", with_(_ORDERS_SQL, "select o_custkey, o_orderkey, price from (select *, row_number() over (partition by o_custkey order by day desc, o_orderkey desc) as k from o) where k <= 2"))
def latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return asof.first_per_key(_orders(spark, sf), ["o_custkey"], [F.desc("day"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "price")


_CUTS = ["2024-01-05 12:00:00", "2024-01-20 12:00:00", "2024-01-31 00:00:00"]


@query("evidence_resolution", f"""with t as (select distinct user_id, cast(cut as timestamp) as cut from events, (select unnest({_CUTS}) as cut)),
    l as (select t.user_id, t.cut, event_type as c, arg_max(cast(floor(value) as bigint) % 3, (ts, -(cast(floor(value) as bigint) % 3))) as r from t join events e on e.user_id = t.user_id and e.ts <= t.cut group by 1, 2, 3),
    m as (select user_id, cut, min(r) as least from l group by 1, 2), x as (select user_id, cut, list_sort(list(c)) as cs from l join m using (user_id, cut) where r = least group by 1, 2)
    select t.user_id, cast(t.cut as varchar) as cut, array_to_string(cs, ',') as candidates, case when len(cs) > 1 then 'AMBIGUOUS' when len(cs) = 1 then 'SUPPORTED' else 'UNKNOWN' end as state,
           case when len(cs) > 0 then least(len(cs), 2) else 1 end as n_scenarios from t left join x using (user_id, cut)""")
def evidence_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's leading event types as of three cutoffs."""
    e = load(spark, sf, "events").select("user_id", "event_type", (F.floor("value") % 3).alias("rank"), "ts")
    targets = e.select("user_id").distinct().select("user_id", F.explode(F.array(*(F.lit(c).cast("timestamp") for c in _CUTS))).alias("cut"))
    out = asof.resolved(targets, e, ["user_id"], "event_type", "rank", "ts", "cut", "SUPPORTED")
    many = reshape.scenarios(out, "candidates").groupBy("user_id", "cut").agg(F.count(F.lit(1)).alias("n_scenarios"))
    return out.join(many, ["user_id", "cut"]).select("user_id", F.col("cut").cast("string").alias("cut"), F.array_join("candidates", ",").alias("candidates"), "state", "n_scenarios")


_HOT_SQL = """e as (select event_id, event_type, user_id, value, ts from events),
    t as (select event_type, cast(ts as date) as day from events group by 1, 2)"""


@query("asof_hot_entity", with_(_HOT_SQL, """r as (select t.event_type, t.day, e.event_id, e.value, row_number() over (partition by t.event_type, t.day order by e.ts desc, e.event_id desc) as k
        from t join (select event_type, cast(ts as date) as d, max(struct_pack(ts := ts, event_id := event_id, value := value)) as x from events group by 1, 2) g on g.event_type = t.event_type and g.d < t.day
        cross join (select g.x.ts as ts, g.x.event_id as event_id, g.x.value as value) e)
    select t.event_type, cast(t.day as varchar) as day, r.event_id, r.value from t left join r on r.event_type = t.event_type and r.day = t.day and r.k = 1"""))
def asof_hot_entity(spark: SparkSession, sf: str) -> DataFrame:
    """WN-00 where a few entities (event types) hold all facts: the last event before each day, timelines cut into slices."""
    e = load(spark, sf, "events").select("event_type", "event_id", "value", "ts")
    targets = e.select("event_type", F.to_date("ts").alias("day")).distinct().withColumn("as_of", F.col("day").cast("timestamp") - F.expr("interval 1 microsecond"))
    out = asof.asof(targets, e, ["event_type"], "as_of", "ts", ["event_id", "value"], ["event_id"], sliced=True)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "event_id", "value")


@query("entering_state_hot", with_("d as (select o_orderstatus as entity, datediff('day', date '1990-01-01', cast(o_orderdate as date)) as block_ord, count(*) as n, sum(cast(floor(o_totalprice) as bigint)) as num from orders group by 1, 2)",
    """select entity, block_ord, cast(coalesce(sum(num) over w, 0) as bigint) as num, cast(coalesce(sum(n) over w, 0) as bigint) as n from d window w as (partition by entity order by block_ord rows between unbounded preceding and 1 preceding)"""))
def entering_state_hot(spark: SparkSession, sf: str) -> DataFrame:
    """WN-05 where a few entities have an update on nearly every day."""
    o = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("entity"), F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("block_ord"), F.floor("o_totalprice").cast("long").alias("num"), F.lit(1).cast("long").alias("n"))
    return history.entering_state(o, ["entity"], sums=("num", "n"), sliced=True)
