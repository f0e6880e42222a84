"""PL-08 as queries: a ledger over all games of orders, with DuckDB SQL for every view but the bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.plans.base import GAMES_SQL, games, query, with_
from tidemark.plans.forensics import CHANCE_BANDS, EDGE_BANDS, PRICE_BANDS, forensics
from tidemark.plans.offer_queries import _CDF

UNTIL = 1998

#: Games with two chances and a book's two prices; each game's side with an edge is a bet. Every 97th row's profit and
#: every 101st row's chance are wrong, and every 89th row has the other side's price.
_ROWS_SQL = GAMES_SQL + """,
gm0 as (select game, season, month as week, home, away, home_score, away_score, (game % 89 + 5) / 100.0 as p_a, case when game % 23 > 0 then (game % 53 + 20) / 100.0 end as p_b, game * 37 % 301 - 150 as x, game * 53 % 301 - 150 as y from games where home <> away),
gm1 as (select *, case when x >= 0 then 100 + x else x - 100 end as home_price, case when y >= 0 then 100 + y else y - 100 end as away_price from gm0),
gm2 as (select *, case when home_price > 0 then 1 + home_price / 100.0 else 1 - 100.0 / home_price end as dh, case when away_price > 0 then 1 + away_price / 100.0 else 1 - 100.0 / away_price end as da from gm1),
gm as (select *, (1 / dh) / (1 / dh + 1 / da) as fair_home, coalesce((p_a + p_b) / 2, p_a) as p_home from gm2),
cd0 as (select *, case when p_home > fair_home then 'home' else 'away' end as side from gm),
cd1 as (select *, case when game % 89 = 0 then case side when 'home' then away_price else home_price end else case side when 'home' then home_price else away_price end end as price, case side when 'home' then p_home else 1 - p_home end as ps, case side when 'home' then fair_home else 1 - fair_home end as fair from cd0),
cd2 as (select *, case when price > 0 then 1 + price / 100.0 else 1 - 100.0 / price end as dec, sign(home_score - away_score) * case side when 'home' then 1 else -1 end as s from cd1),
r as (select game, season, week, side, case when game % 101 = 0 then ps + 0.01 else ps end as p_model, 100 * (ps - fair) as edge, price, 'b' || (game % 6) as book, case when s > 0 then 1 when s < 0 then 0 end as win, s = 0 as push,
        case when s > 0 then dec - 1 when s < 0 then -1.0 else 0.0 end + case when game % 97 = 0 then 0.5 else 0 end as profit, home, away, home_score, away_score, p_a, p_b, fair, dec, s, ps,
        case side when 'home' then home else away end as team, case side when 'home' then p_a else 1 - p_a end as pas, case side when 'home' then p_b else 1 - p_b end as pbs,
        case side when 'home' then home_price else away_price end as price_side, case side when 'home' then away_price else home_price end as price_other, case when season <= 1998 then 'DISCOVERY' else 'CONFIRMATION' end as period from cd2)"""


def _frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    g = games(spark, sf).where("home <> away")
    price = lambda k: (F.col("game") * k % 301 - 150)
    american = lambda c: F.when(c >= 0, 100 + c).otherwise(c - 100)
    g = g.select("game", "season", F.col("month").alias("week"), "home", "away", "home_score", "away_score", ((F.col("game") % 89 + 5) / 100.0).alias("p_a"), F.when(F.col("game") % 23 > 0, (F.col("game") % 53 + 20) / 100.0).alias("p_b"), american(price(37)).alias("home_price"), american(price(53)).alias("away_price"))
    g = g.withColumn("fair_home", fn.no_vig("home_price", "away_price")).withColumn("_p", F.coalesce((F.col("p_a") + F.col("p_b")) / 2, F.col("p_a")))
    home = F.col("side") == "home"
    c = g.withColumn("side", F.when(F.col("_p") > F.col("fair_home"), "home").otherwise("away"))
    own, other = F.when(home, F.col("home_price")).otherwise(F.col("away_price")), F.when(home, F.col("away_price")).otherwise(F.col("home_price"))
    c = c.withColumns({"price": F.when(F.col("game") % 89 == 0, other).otherwise(own), "_ps": fn.oriented("side", "_p")})
    c = c.withColumn("_g", fn.graded(F.lit("moneyline"), F.col("side"), F.lit(None).cast("double"), "home_score", "away_score", fn.american_to_decimal("price")))
    c = c.select(
        "game", "season", "week", "side", F.when(F.col("game") % 101 == 0, F.col("_ps") + 0.01).otherwise(F.col("_ps")).alias("p_model"), (100 * (F.col("_ps") - fn.oriented("side", "fair_home"))).alias("edge"), "price", F.concat(F.lit("b"), F.col("game") % 6).alias("book"),
        F.when(~F.col("_g.push"), F.col("_g.win").cast("int")).alias("win"), F.col("_g.push").alias("push"), (F.col("_g.profit") + F.when(F.col("game") % 97 == 0, 0.5).otherwise(0.0)).alias("profit"),
    )
    return forensics(c, g.drop("_p", "week"), UNTIL)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, kind in df.dtypes if kind == "double"})


_RECORD = "count(*) as n, count(*) filter (win = 1) as wins, count(*) filter (win = 0) as losses, count(*) filter (push) as pushes, round(count(*) filter (win = 1) / count(*), 6) as hit_rate, round(sum(profit), 6) as profit, round(sum(profit) / count(*), 6) as roi"


def _bands(column: str, bands: dict[str, tuple[float, float]], closed: bool = False) -> str:
    return "case " + " ".join(f"when {column} >= {low} and {column} {'<=' if closed else '<'} {high} then '{name}'" for name, (low, high) in bands.items()) + " end"


_CALIBRATED = "count(*) as n, round(avg(y), 6) as observed, round(avg(p), 6) as mean_p, round(100 * (avg(p) - avg(y)), 6) as gap, round(avg(pow(p - y, 2)), 6) as brier, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy"
_OWN = "own as (select season, model, " + _CALIBRATED + " from (select season, 'mean' as model, p_model as p, win * 1.0 as y from r union all select season, 'a', pas, win from r union all select season, 'b', pbs, win from r) where p is not null and y is not null group by 1, 2)"
_VIEWS = {
    "sides": f"select season, side, case when season is null then 'side' else 'season+side' end as grain, {_RECORD} from r group by grouping sets ((season, side), (side))",
    "identity": "select game, season, side, round(p_model, 6) as p_model, price, round(fair, 6) as fair, price_side, price_other, price > 100 as plus_money, fair < 0.5 as underdog_by_fair, price_side > 100 as underdog_by_price, fair >= 0.5 as favorite_by_fair, abs(price - price_other) <= 1 as price_is_the_others from r",
    "recomputed": "select game, season, side, price, home_score, away_score, win, case when s > 0 then 1 when s < 0 then 0 end as win_again, round(profit, 6) as profit, round(case when s > 0 then dec - 1 when s < 0 then -1.0 else 0.0 end, 6) as profit_again, game % 97 <> 0 as matches from r",
    "chance_bands": f"select season, {_bands('p_model', CHANCE_BANDS)} as chance_band, {_RECORD} from r where {_bands('p_model', CHANCE_BANDS)} is not null group by 1, 2",
    "interaction": f"""select season, side, {_bands('p_model', CHANCE_BANDS)} as chance_band, null as edge_band, 'season+side+chance_band' as grain, {_RECORD} from r where {_bands('p_model', CHANCE_BANDS)} is not null group by 1, 2, 3
        union all select season, side, null, {_bands('edge', EDGE_BANDS)}, 'season+side+edge_band', {_RECORD} from r where {_bands('edge', EDGE_BANDS)} is not null group by 1, 2, 4""",
    "book_mix": f"select season, book, case when season is null then 'book' else 'season+book' end as grain, {_RECORD} from r group by grouping sets ((season, book), (book))",
    "price_bands": f"with b as (select *, {_bands('price', PRICE_BANDS, True)} as price_band from r) select season, price_band, case when season is null then 'price_band' else 'season+price_band' end as grain, {_RECORD} from b where price_band is not null group by grouping sets ((season, price_band), (price_band))",
    "distributions": "with z as (select unnest(['ALL', season::varchar]) as scope, fair, 100 * (p_model - fair) as over from r) select scope, round(avg(fair), 6) as mean_fair, round(avg(over), 6) as mean_edge, " + ", ".join(f"round(quantile_cont({c}, {k / 4}), 6) as {c}_q{k}" for c in ("fair", "over") for k in (1, 2, 3)) + " from z group by 1",
    "teams": """with z as (select unnest(['ALL', period, 'season_' || season]) as scope, team, profit from r), t as (select scope, team, count(*) as n, sum(profit) as s from z group by 1, 2), k as (select *, row_number() over (partition by scope order by s, team) as k from t)
        select scope, cast(sum(n) as bigint) as n, round(sum(case when s < 0 then -s else 0 end), 6) as total_loss, arg_max(team, (abs(s), team)) as largest, round(arg_max(s, (abs(s), team)), 6) as largest_profit, arg_max(team, (n, team)) as most_rows, coalesce(list(team order by k) filter (s < 0 and k <= 5), []) as worst,
            round(coalesce(sum(-s) filter (s < 0 and k <= 1), 0) / nullif(sum(case when s < 0 then -s else 0 end), 0), 6) as worst_share, round(coalesce(sum(-s) filter (s < 0 and k <= 3), 0) / nullif(sum(case when s < 0 then -s else 0 end), 0), 6) as worst_three_share from k group by 1""",
    "chronology": "select season, week, game, side, count(*) over w as bet_no, count(*) filter (profit > 0) over w as cum_wins, round(sum(profit) over w, 4) + 0.0 as cum_profit, round(sum(profit) over w / count(*) over w, 4) + 0.0 as cum_roi from r window w as (partition by season order by week, game, side rows between unbounded preceding and current row)",
    "disagreement": "select season, case when season is null then 'ALL' else 'season' end as grain, count(*) as n, round(100 * avg(abs(pas - pbs)), 6) as mean_spread, round(100 * stddev_samp(abs(pas - pbs)), 6) as std_spread, count(*) filter (pas > pbs) as n_a_higher, count(*) filter (pas <= pbs) as n_b_higher from r where pbs is not null group by grouping sets ((season), ())",
    "orientation": "select game, season, side, round(p_model, 6) as p_model, round(ps, 6) as p_from_sides, game % 101 <> 0 as matches from r",
}


def _sql(view: str, body: str) -> str:
    head, _, rest = body.partition("select ")
    if head.startswith("with "):
        return f"with {_ROWS_SQL}, {body[5:]}"
    return f"with {_ROWS_SQL} {body}"


def _register(view: str, sql: str | None, digits: int = 6) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(_frames(spark, sf)[view], digits)

    run.__doc__ = f"PL-08: {view.replace('_', ' ')}."
    query(f"forensic_{view}", sql)(run)


for _view, _body in _VIEWS.items():
    _register(_view, _sql(_view, _body), 4 if _view == "chronology" else 6)
_register("calibration", with_(_ROWS_SQL, _OWN, "z as (select 1) select * from own"))
_register("global_calibration", with_(_ROWS_SQL, _OWN, f"""w as (select season, model, {_CALIBRATED} from (select season, m.model, case m.model when 'a' then p_a when 'b' then p_b else (p_a + p_b) / 2 end as p, case when home_score > away_score then 1.0 when home_score < away_score then 0.0 end as y from gm, (values ('a'), ('b'), ('mean')) m(model)) where p is not null and y is not null group by 1, 2)
    select w.*, own.gap as slice_gap from w left join own on own.season = w.season and own.model = 'mean'"""))
_register("proportions", with_(_ROWS_SQL, f"""s as (select count(*) filter (win = 1 and period = 'DISCOVERY') * 1.0 as a, count(*) filter (period = 'DISCOVERY') * 1.0 as m, count(*) filter (win = 1 and period = 'CONFIRMATION') * 1.0 as b, count(*) filter (period = 'CONFIRMATION') * 1.0 as n from r),
    t as (select a / m - b / n as d, sqrt((a + b) / (m + n) * (1 - (a + b) / (m + n)) * (1 / m + 1 / n)) as se, greatest(abs(a / m - b / n) - (1 / m + 1 / n) / 2, 0) * sign(a / m - b / n) as f from s), q as (select d / se as z, f / se as zc from t)
    select round(z, 6) as z, round(2 * (1 - {_CDF.format('abs(z)')}), 6) as p_value, round(zc, 6) as z_corrected, round(2 * (1 - {_CDF.format('abs(zc)')}), 6) as p_corrected from q"""))
_register("block_hit_rate", None)
_register("block_roi", None)
