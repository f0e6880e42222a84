"""The composite pipelines as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reshape
from tidemark.plans import pipelines
from tidemark.plans.base import GAMES_SQL, PLAYS_SQL, QUOTES_SQL, games, load, plays, query, quotes, with_
from tidemark.plans.history_queries import FLAGS_SQL, after_sql, before_sql
from tidemark.plans.offer_queries import _RANK, _SUMMARY
from tidemark.sources import sinks
from tidemark.sources.readers import table
from tidemark.sources.scratch import scratch


_BUNDLE_SQL = f"""g as (select * from games where home <> away),
    bl as (select block_ord, {before_sql('min(day)')} as as_of, {after_sql('max(day)')} as available_at from g group by 1),
    f as (select s.entity, g.game, g.season, bl.available_at, s.points from g join bl using (block_ord), lateral (values (home, home_score), (away, away_score)) s(entity, points)),
    t as (select distinct s.entity, block_ord, as_of from g join bl using (block_ord), lateral (values (home), (away)) s(entity)),
    r as (select t.entity, t.block_ord, f.season, f.points, row_number() over w as k, first_value(f.season) over w as last_season from t join f on f.entity = t.entity and f.available_at <= t.as_of window w as (partition by t.entity, t.block_ord order by f.available_at desc, f.game desc)),
    en as (select entity, block_ord, avg(points) filter (k <= 4) as r4, avg(points) filter (k <= 8) as r8, avg(points) filter (season = last_season) as sm, count(*) filter (season = last_season) as sn from r group by 1, 2),
    e as (select 'e' || (c_custkey % 25) as entity, c_name as c, cast(trunc(c_acctbal) as int) as rk, epoch_us(timestamp '1995-06-01' + to_days(cast(c_custkey % 1500 as int))) as at from customer),
    l as (select t.entity, t.block_ord, c, rk, min(rk) over (partition by t.entity, t.block_ord) as least from t join e on e.entity = t.entity and e.at <= t.as_of),
    st as (select entity, block_ord, count(*) as n, min(c) as c from l where rk = least group by 1, 2),
    pf as (select c_name as player, g.game, bl.available_at, o_totalprice as price from orders join customer on c_custkey = o_custkey join g on g.game = o_orderkey join bl on bl.block_ord = g.block_ord),
    pq as (select distinct c as player, st.block_ord, as_of from st join bl using (block_ord)),
    pk as (select pq.player, pq.block_ord, price, row_number() over (partition by pq.player, pq.block_ord order by pf.available_at desc, pf.game desc) as k from pq join pf on pf.player = pq.player and pf.available_at <= pq.as_of),
    pa as (select player, block_ord, avg(price) filter (k <= 4) as p4 from pk where k <= 8 group by 1, 2)"""


def _bundle_side(s: str) -> str:
    return f"""round(coalesce({s}n.r4, 20.0), 6) as {s}_roll4_points, {s}n.r4 is null as {s}_roll4_points_imputed, round(coalesce({s}n.r8, 20.0), 6) as {s}_roll8_points, round({s}n.sm, 6) as {s}_std_points_mean, {s}n.sn as {s}_std_points_n,
        case when {s}t.n is null then 'UNKNOWN' when {s}t.n = 1 then 'DEPTH_CHART_SUPPORTED' else 'AMBIGUOUS' end as {s}_starter_state, {s}t.c as {s}_candidate, round(coalesce({s}p.p4, 1000.0), 4) as {s}_passer_roll4_price"""


_BUNDLE_JOINS = " ".join(f"left join en {s}n on {s}n.entity = g.{s} and {s}n.block_ord = g.block_ord left join st {s}t on {s}t.entity = g.{s} and {s}t.block_ord = g.block_ord left join pa {s}p on {s}p.player = {s}t.c and {s}p.block_ord = g.block_ord" for s in ("home", "away"))


@query("feature_bundle", with_(GAMES_SQL, _BUNDLE_SQL, f"z as (select 1) select g.game, g.season, g.block_ord, {_bundle_side('home')}, {_bundle_side('away')} from g {_BUNDLE_JOINS}"))
def feature_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """PL-01. The wide rows: entity features, starters and the passer features of the first scenario."""
    g = games(spark, sf).where("home <> away").select("game", "season", "block_ord", "day", "home", "away", "home_score", "away_score")
    facts = g.selectExpr("game", "season", "day", "stack(2, home, home_score, away, away_score) as (entity, points)")
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    evidence = c.selectExpr("concat('e', c_custkey % 25) as entity", "c_name as candidate", "cast(c_acctbal as int) as rank", "timestamp'1995-06-01 00:00:00' + make_dt_interval(c_custkey % 1500) as at")
    passers = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_name").alias("player"), F.col("o_orderkey").alias("game"), F.col("o_totalprice").alias("price"))
    w = pipelines.feature_bundle(g.drop("home_score", "away_score"), facts, evidence, {"points": 20.0}, passers, {"price": 1000.0}).wide
    r = lambda c, k=6: F.round(c, k).alias(c)
    side = lambda s: (r(f"{s}_roll4_points"), f"{s}_roll4_points_imputed", r(f"{s}_roll8_points"), r(f"{s}_std_points_mean"), f"{s}_std_points_n", f"{s}_starter_state", f"{s}_candidate", r(f"{s}_passer_roll4_price", 4))
    return w.select("game", "season", "block_ord", *side("home"), *side("away"))


#: Orders with line items as games of seven entities, with context and starters by order; a play's side is its game's.
TOTALS_SQL = """tg as (select l_orderkey as game, cast(min(year(l_shipdate) * 12 + month(l_shipdate)) as int) as block_ord, min(l_suppkey) as s from lineitem group by 1),
    g as (select game, block_ord, 's' || (s % 7) as home, 's' || ((s + 1) % 7) as away from tg),
    own as (select fs.* exclude (posteam), case when fs.posteam in ('s0', 's2', 's4', 's6') then g.home when fs.posteam is not null then g.away end as posteam from fs join g using (game)),
    dr as (select game, drive, posteam, arg_min(result, play_id) filter (result is not null) as result, count(*) filter (is_valid) as v, count(*) filter (is_turnover) as t, count(*) filter (is_valid and yardline_100 <= 20) as r, count(*) filter (is_valid and goal_to_go = 1) as gg from own where posteam is not null group by 1, 2, 3),
    dv as (select * from dr where v > 0 and result is not null),
    ck as (select *, case when qb_spike = 0 and qb_kneel = 0 then game_seconds_remaining end as clock from own where is_valid),
    iv as (select game, posteam, lag(clock) over w - clock as d, lag(is_neutral) over w as pn, qtr = lag(qtr) over w as sq from ck window w as (partition by game, drive, posteam order by play_id)),
    ok as (select * from iv where d > 0 and d <= 120 and sq),
    ml as (select game, posteam as e, 'epa_per_play' as m, epa as x, 1.0 as w from own where is_valid and epa is not null
        union all select game, posteam, 'success_rate', success, 1.0 from own where is_valid and success is not null
        union all select game, posteam, 'neutral_pass_rate', case when is_pass then 1.0 else 0.0 end, (case when is_pass then 1.0 else 0.0 end) + (case when is_rush then 1.0 else 0.0 end) from own where is_neutral and (is_pass or is_rush)
        union all select game, posteam, 'sacks_per_dropback', case when sack = 1 then 1.0 else 0.0 end, 1.0 from own where is_dropback and sack is not null
        union all select game, posteam, 'air_yards_per_attempt', air_yards, 1.0 from own where is_pass and air_yards is not null
        union all select game, posteam, 'yac_per_completion', yards_after_catch, 1.0 from own where is_completion and yards_after_catch is not null
        union all select game, posteam, 'explosive_pass_rate', case when yards_gained >= 20 then 1.0 else 0.0 end, 1.0 from own where is_pass and yards_gained is not null
        union all select game, posteam, 'explosive_rush_rate', case when yards_gained >= 10 then 1.0 else 0.0 end, 1.0 from own where is_rush and yards_gained is not null
        union all select game, posteam, 'points_per_drive', case result when 'Touchdown' then 7.0 when 'Field goal' then 3.0 end, 1.0 from dv
        union all select game, posteam, 'scoring_drive_rate', 1.0, 1.0 from dv union all select game, posteam, 'turnovers_per_drive', t, 1.0 from dv
        union all select game, posteam, 'red_zone_td_rate', case result when 'Touchdown' then 1.0 else 0.0 end, 1.0 from dv where r > 0 union all select game, posteam, 'goal_to_go_td_rate', case result when 'Touchdown' then 1.0 else 0.0 end, 1.0 from dv where gg > 0
        union all select game, posteam, 'seconds_per_play', d, 1.0 from ok union all select game, posteam, 'neutral_seconds_per_play', d, 1.0 from ok where pn),
    mm as (select ml.*, g.block_ord as b, case when e = g.home then g.away else g.home end as o from ml join g using (game)),
    eb as (select e, m, b, sum(x) as x, sum(w) as w from (select e, m, b, x, w from mm union all select o, m || '_allowed', b, x, w from mm) group by 1, 2, 3),
    cal as (select distinct e, b from (select home as e, block_ord as b from g union all select away, block_ord from g)),
    st as (select cal.e, cal.b, eb.m, sum(eb.x) as x, sum(eb.w) as w from cal join eb on eb.e = cal.e and eb.b < cal.b group by 1, 2, 3)"""


def _totals_sql() -> str:
    rates = ", ".join(f"max(case when m = '{f}{a}' and w >= {least} then x / w end) as {f}{a}" for f, least in pipelines.FAMILIES.items() for a in ("", "_allowed"))
    pairs = ", ".join(f"round(({x}.{f} + {y}.{f}_allowed) / 2 + 1e-9, 6) as {s}_matchup_{f}, case when {x}.{f} is null or {y}.{f}_allowed is null then 1 else 0 end as {s}_matchup_{f}_missing" for f in pipelines.FAMILIES for s, x, y in (("away", "a", "h"), ("home", "h", "a")))
    rest = ", ".join(f"cx.{s}_rest as {s}_rest_days, case when cx.{s}_rest is null then 1 else 0 end as {s}_rest_days_missing" for s in ("away", "home"))
    kind = ", ".join(f"coalesce(lower(cx.{c}), 'unknown') as {c}_category, case when cx.{c} is null then 1 else 0 end as {c}_missing" for c in ("roof", "surface"))
    numbers = ", ".join(f"case when {n} then cast((o_orderkey + {7 * k + (3 if s == 'home' else 0)}) % {11 + k} as {'int' if 'imputed' in c or c in ('low_sample', 'missing_player_id') else 'double'}) % {2 if 'imputed' in c or c in ('low_sample', 'missing_player_id') else 100} end as {s}_qb_{c}" for s, n in (("away", "o_orderkey % 3 <> 0"), ("home", "true")) for k, c in enumerate(pipelines.PASSER))
    qb = ", ".join(f"cx.{s}_qb_{c}" for s in ("away", "home") for c in pipelines.PASSER)
    context = f"cx as (select o_orderkey as game, case when o_orderkey % 5 <> 0 then cast(o_custkey % 15 as int) end as away_rest, case when o_orderkey % 7 <> 0 then cast(o_custkey % 12 as int) end as home_rest, case when o_orderkey % 4 <> 0 then o_orderpriority end as roof, case when o_orderkey % 9 <> 0 then o_orderstatus end as surface, {numbers} from orders)"
    return with_(PLAYS_SQL, FLAGS_SQL, TOTALS_SQL, context, f"rt as (select e, b, {rates} from st group by 1, 2)\n select g.game, g.block_ord, g.home, g.away, {rest}, {kind}, {qb}, {pairs} from g left join rt h on h.e = g.home and h.b = g.block_ord left join rt a on a.e = g.away and a.b = g.block_ord left join cx on cx.game = g.game")


@query("totals_table", _totals_sql())
def totals_table(spark: SparkSession, sf: str) -> DataFrame:
    """PL-03. All ninety columns of each game."""
    g = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(F.min(F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("block_ord"), F.min("l_suppkey").alias("s"))
    path = scratch(spark, "games")
    # the schedule is a table of its own, read by every step
    sinks.frozen(g.selectExpr("game", "block_ord", "concat('s', s % 7) as home", "concat('s', (s + 1) % 7) as away"), path)
    g = table(spark, path)
    p = plays(spark, sf, by_game=True)
    own = p.join(g, "game").withColumn("posteam", F.when(F.col("posteam").isin("s0", "s2", "s4", "s6"), F.col("home")).when(F.col("posteam").isNotNull(), F.col("away")))
    o = load(spark, sf, "orders").withColumnRenamed("o_orderkey", "game")
    context = o.selectExpr("game", "case when game % 5 <> 0 then o_custkey % 15 end as away_rest", "case when game % 7 <> 0 then o_custkey % 12 end as home_rest", "case when game % 4 <> 0 then o_orderpriority end as roof", "case when game % 9 <> 0 then o_orderstatus end as surface")
    sides = o.select("game", F.explode(F.when(F.col("game") % 3 != 0, F.array(F.lit("away"), F.lit("home"))).otherwise(F.array(F.lit("home")))).alias("side"))
    shift = F.when(F.col("side") == "home", 3).otherwise(0)
    number = lambda k: (F.col("game") + 7 * k + shift) % (11 + k)
    is_flag = lambda c: "imputed" in c or c in ("low_sample", "missing_player_id")
    passers = sides.select("game", "side", *((number(k) % 2 == 1).alias(c) if is_flag(c) else number(k).cast("double").alias(c) for k, c in enumerate(pipelines.PASSER)))
    return pipelines.totals_table(own, g, context, passers, lambda rate: F.round(rate + 1e-9, 6))


_CENSUS_SQL = with_(QUOTES_SQL, f"""m as (select 'a' as model, game, (game % 89 + 5) / 100.0 as ph from (select distinct game from quotes) union all select 'b', game, (game % 53 + 20) / 100.0 from (select distinct game from quotes)),
    sd as (select model, game, side, case side when 'home' then ph else 1 - ph end as p from m, (values ('home'), ('away')) s(side)),
    k as (select game, side, price, book, row_number() over (partition by game, side order by price desc, {_RANK}, book) as k from quotes where market = 'moneyline'),
    x as (select game, max(price) filter (side = 'home') as h, max(price) filter (side = 'away') as a from quotes where market = 'moneyline' and book = 'b0' group by 1),
    y as (select game, 1 / (case when h > 0 then 1 + h / 100.0 else 1 - 100.0 / h end) as qh, 1 / (case when a > 0 then 1 + a / 100.0 else 1 - 100.0 / a end) as qa from x),
    z as (select game, qh / (qh + qa) as f from y)""")


@query("edge_census", _CENSUS_SQL + """
    select sd.game, model, sd.side, round(p, 6) as p, round(case sd.side when 'home' then f else 1 - f end, 6) as p_market, k.book as best_book, k.price as best_price, round(p - 1 / (case when k.price > 0 then 1 + k.price / 100.0 else 1 - 100.0 / k.price end), 6) as edge
    from sd left join k on k.k = 1 and k.game = sd.game and k.side = sd.side left join z on z.game = sd.game""")
def edge_census(spark: SparkSession, sf: str) -> DataFrame:
    return _census(spark, sf).select("game", "model", "side", *(F.round(c, 6).alias(c) for c in ("p", "p_market")), "best_book", "best_price", F.round("edge", 6).alias("edge"))


def _census(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    ids = q.select("game").distinct()
    models = {"a": ids.withColumn("p_home", (F.col("game") % 89 + 5) / 100.0), "b": ids.withColumn("p_home", (F.col("game") % 53 + 20) / 100.0)}
    return pipelines.edge_census(models, q, ["b3", "b0"], "b0")


_FAMILIES_SQL = f"""bk as (select game, book, market, side, max((price, line)) as x from quotes group by 1, 2, 3, 4),
    bq as (select game, book, market, side, cast(x[1] as bigint) as price, x[2] as line, case when x[1] > 0 then 1 + x[1] / 100.0 else 1 - 100.0 / x[1] end as dec from (select game, book, market, side, [x[1], x[2]] as x from bk)),
    sd as (select game, market, side, max(dec) filter (book = 'b0') as anchor, max(line) filter (book = 'b0') as anchor_line, max(dec) filter (book = 'b1') as backup, max(dec) filter (book = 'b2') as d2, max(dec) filter (book = 'b3') as d3 from bq group by 1, 2, 3),
    ac as (select game, market, side, price, book, line, dec, row_number() over (partition by game, market, side order by dec desc, book) as k from bq where book in ('b2', 'b3')),
    s as (select sd.*, ac.price, ac.book, ac.line, ac.dec from sd left join ac on ac.k = 1 and ac.game = sd.game and ac.market = sd.market and ac.side = sd.side),
    pr as (select game, max(anchor) filter (side = 'home') as ha, max(anchor) filter (side = 'away') as aa, max(backup) filter (side = 'home') as hb, max(backup) filter (side = 'away') as ab from sd where market = 'moneyline' group by 1),
    pm as (select *, coalesce((ha + hb) / 2, ha, hb) as hm, coalesce((aa + ab) / 2, aa, ab) as am from pr),
    fr as (select game, (1 / ha) / (1 / ha + 1 / aa) as f, (1 / hm) / (1 / hm + 1 / am) as r from pm),
    gm as (select distinct game, home_score, away_score from quotes),
    md as (select 'a' as model, game, (game % 89 + 5) / 100.0 as ph from gm union all select 'b', game, (game % 53 + 20) / 100.0 from gm),
    tw as (select md.game, model, z.side, case z.side when 'home' then ph else 1 - ph end as p, 100 * (case z.side when 'home' then ph - f else f - ph end) as edge, 100 * (case z.side when 'home' then ph - r else r - ph end) as edge_backup,
           (case z.side when 'home' then ph else 1 - ph end) * s.dec - 1 as value, s.price, s.book from md cross join (values ('home'), ('away')) z(side) left join fr on fr.game = md.game left join s on s.market = 'moneyline' and s.game = md.game and s.side = z.side),
    pe as (select *, row_number() over (partition by game, model order by side desc) as k from tw where edge > 0),
    pt as (select gm.game, 'spread' as market, home_score - away_score + gm.game % 15 - 7 + anchor_line as gap from gm join sd on sd.game = gm.game and sd.market = 'spread' and sd.side = 'home' where anchor_line is not null
        union all select gm.game, 'total', home_score + away_score + gm.game % 11 - 5 - anchor_line from gm join sd on sd.game = gm.game and sd.market = 'total' and sd.side = 'over' where anchor_line is not null),
    pc as (select game, market, case market when 'spread' then case when gap > 0 then 'home' else 'away' end else case when gap > 0 then 'over' else 'under' end end as side, abs(gap) as points from pt where abs(gap) > 1e-9)
    select 'TWO_SIDED' as family, game, model, side, round(p, 6) as p, round(edge, 6) as edge, round(edge_backup, 6) as edge_backup, round(value, 6) as value, price, book, cast(null as double) as points, cast(null as double) as line, cast(null as double) as anchor_line, cast(null as int) as n_better, cast(null as int) as n_equal, cast(null as int) as n_worse from tw
    union all select 'POSITIVE_EDGE', game, model, side, round(p, 6), round(edge, 6), round(edge_backup, 6), round(value, 6), price, book, null, null, null, null, null, null from pe where k = 1
    union all select upper(pc.market), pc.game, null, pc.side, null, null, null, null, s.price, s.book, round(points, 6), s.line, s.anchor_line, (d2 - anchor > 1e-9 is true)::int + (d3 - anchor > 1e-9 is true)::int, (abs(d2 - anchor) <= 1e-9 is true)::int + (abs(d3 - anchor) <= 1e-9 is true)::int, (d2 - anchor < -1e-9 is true)::int + (d3 - anchor < -1e-9 is true)::int
        from pc left join s on s.game = pc.game and s.market = pc.market and s.side = pc.side"""


@query("census_families", with_(QUOTES_SQL, _FAMILIES_SQL))
def census_families(spark: SparkSession, sf: str) -> DataFrame:
    """PL-06. All four families."""
    q = quotes(spark, sf)
    ids = q.select("game", "home_score", "away_score").distinct()
    models = reshape.stacked([ids.select("game", F.lit(m).alias("model"), p.alias("p_home")) for m, p in (("a", (F.col("game") % 89 + 5) / 100.0), ("b", (F.col("game") % 53 + 20) / 100.0))])
    points = ids.select("game", (F.col("home_score") - F.col("away_score") + F.col("game") % 15 - 7).cast("double").alias("margin"), (F.col("home_score") + F.col("away_score") + F.col("game") % 11 - 5).cast("double").alias("total"))
    out = pipelines.census_families(models, points, q, "b0", "b1", ["b2", "b3"])
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("p", "edge", "edge_backup", "value", "points")})


#: The census of both models with results and grades.
_GRADED_SQL = _CENSUS_SQL + """, rs as (select game, min(season) as season, min(home_score) as hs, min(away_score) as aw from quotes group by 1),
    cs as (select sd.game, sd.model, sd.side, p, k.book as best_book, k.price as best_price, case when k.price > 0 then 1 + k.price / 100.0 else 1 - 100.0 / k.price end as dec from sd left join k on k.k = 1 and k.game = sd.game and k.side = sd.side),
    lg as (select cs.*, p - 1 / dec as edge, season, case when hs = aw then 0.0 when (hs > aw) = (side = 'home') then dec - 1 else -1.0 end as profit, case when season <= 1997 then 'discovery' else 'confirmation' end as period from cs join rs using (game) where p - 1 / dec >= 0.02),
    lb as (select *, case when edge < 0.02 then 'under 2' when edge < 0.05 then '2 to 5' when edge < 0.10 then '5 to 10' else '10 and over' end as bucket from lg)"""


@query("graded_rows", _GRADED_SQL + " select game, model, side, best_book, best_price, round(edge, 6) as edge, round(profit, 6) as profit, period, bucket from lb")
def graded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PL-07. The graded ledger itself."""
    return _graded(spark, sf)[0].select("game", "model", "side", "best_book", "best_price", F.round("edge", 6).alias("edge"), F.round("profit", 6).alias("profit"), "period", "bucket")


def _graded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    results = quotes(spark, sf).groupBy("game").agg(F.min("season").alias("season"), F.min("home_score").alias("home_score"), F.min("away_score").alias("away_score"))
    return pipelines.graded_ledger(_census(spark, sf), results, 0.02, 1997)


@query("graded_ledger", _GRADED_SQL + f""" select period, model, bucket, case grouping(period, model, bucket) when 0 then 'period+model+bucket' when 1 then 'period+model' when 3 then 'period' else 'ALL' end as grain, {_SUMMARY.replace('distinct month', 'distinct season')} from lb group by grouping sets ((period, model, bucket), (period, model), (period), ())""")
def graded_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """PL-07. The ledger summed up by period, model and bucket."""
    out = _graded(spark, sf)[1]
    return out.withColumns({c: F.round(c, 4 if c == "profit" else 6) for c in ("hit_rate", "mean_price", "break_even", "profit", "roi")})


@query("request_plan", """with recursive g as (select o_orderkey as game, cast(o_orderdate as date) as day, epoch_us(timezone('America/New_York', cast(cast(o_orderdate as date) as timestamp) + to_hours(10 + o_orderkey % 9) + to_minutes(o_orderkey % 4 * 15))) as t from orders),
    e as (select *, row_number() over (partition by day order by t, game) as k from g),
    c as (select day, game, k, t, t as start from e where k = 1 union all select e.day, e.game, e.k, e.t, case when e.t - c.start <= 1800000000 then c.start else e.t end from c join e on e.day = c.day and e.k = c.k + 1)
    select cast(day as varchar) as day, count(*) as n_games, count(distinct start) as n_requests, min(start) - 3600000000 as first_request from c group by 1""")
def request_plan(spark: SparkSession, sf: str) -> DataFrame:
    """PL-13. The plan of all orders by day; request_plan_rows has its rows."""
    return request_plan_rows(spark, sf).groupBy("day").agg(F.sum("n").alias("n_games"), F.count(F.lit(1)).alias("n_requests"), F.min("requested_at").alias("first_request"))


@query("request_plan_rows", """with recursive g as (select o_orderkey as game, year(o_orderdate) as season, cast(o_orderdate as date) as day, epoch_us(timezone('America/New_York', cast(cast(o_orderdate as date) as timestamp) + to_hours(10 + o_orderkey % 9) + to_minutes(o_orderkey % 4 * 15))) as t from orders),
    e as (select *, row_number() over (partition by day order by t, game) as k from g),
    c as (select season, day, game, k, t, t as start from e where k = 1 union all
          select e.season, e.day, e.game, e.k, e.t, case when e.t - c.start <= 1800000000 then c.start else e.t end from c join e on e.day = c.day and e.k = c.k + 1)
    select season, cast(day as varchar) as day, cast(day as varchar) || ':' || start as request, start - 3600000000 as requested_at, start as cluster_start, count(*) as n, string_agg(cast(game as varchar), ',' order by game) as games from c group by season, day, start""")
def request_plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PL-13. The plan of all orders, row by row, instants as microseconds."""
    g = load(spark, sf, "orders").selectExpr("o_orderkey as game", "year(o_orderdate) as season", "cast(o_orderdate as date) as day", "concat(10 + o_orderkey % 9, ':', lpad(o_orderkey % 4 * 15, 2, '0')) as clock")
    out = pipelines.request_plan(g)
    return out.select("season", F.col("day").cast("string").alias("day"), "request", *(F.unix_micros(c).alias(c) for c in ("requested_at", "cluster_start")), "n", "games")


@query("forensic_interval")
def forensic_interval(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.plans.offer_queries import ledger

    return pipelines.forensic_report(ledger(spark, sf))["interval"]
