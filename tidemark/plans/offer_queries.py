"""Queries over quotes: prices, best offers, coverage, grading, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import offers
from tidemark.plans.base import QUOTES_SQL, load, query, quotes, with_

BOOKS = ["b3", "b0"]
_DEC = "(case when price > 0 then 1 + price / 100.0 else 1 - 100.0 / price end)"
_RANK = "case book when 'b3' then 1 when 'b0' then 2 else 3 end"


def r6(c) -> F.Column:
    return F.round(c, 6)


@query("odds_math", with_(QUOTES_SQL, f"""d as (select l_orderkey, l_linenumber, price, {_DEC} as dec from quotes)
    select l_orderkey, l_linenumber, round(dec, 6) as decimal_price, cast(round_even(case when dec >= 2 then (dec - 1) * 100 else -100 / (dec - 1) end, 0) as int) as american,
           cast(ceil(case when dec >= 2 then (dec - 1) * 100 else -100 / (dec - 1) end - 1e-12) as int) as conservative, round(1 / dec, 6) as break_even from d"""))
def odds_math(spark: SparkSession, sf: str) -> DataFrame:
    d = quotes(spark, sf).withColumn("dec", fn.american_to_decimal("price"))
    return d.select("l_orderkey", "l_linenumber", r6("dec").alias("decimal_price"), fn.decimal_to_american("dec").alias("american"), fn.conservative_american("dec").alias("conservative"), r6(fn.break_even("price")).alias("break_even"))


@query("no_vig_pair", with_(QUOTES_SQL, f"""b as (select game, book, max(1 / {_DEC}) filter (side = 'home') as qh, max(1 / {_DEC}) filter (side = 'away') as qa, max(price) filter (side = 'home') as ph, max(price) filter (side = 'away') as pa from quotes where market = 'moneyline' group by 1, 2),
    d as (select game, book, ph, pa from b where ph is not null and pa is not null),
    q as (select game, book, 1 / (case when ph > 0 then 1 + ph / 100.0 else 1 - 100.0 / ph end) as h, 1 / (case when pa > 0 then 1 + pa / 100.0 else 1 - 100.0 / pa end) as a from d)
    select game, book, round(h / (h + a), 6) as p_home from q"""))
def no_vig_pair(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).where("market = 'moneyline'")
    pair = q.groupBy("game", "book").agg(*(F.max(F.when(F.col("side") == s, F.col("price"))).alias(s) for s in ("home", "away"))).where("home is not null and away is not null")
    return pair.select("game", "book", r6(fn.no_vig("home", "away")).alias("p_home"))


_CLIP = "greatest(0.01, least(0.99, {}))"
_LOGIT = f"ln({_CLIP.format('{0}')} / (1 - {_CLIP.format('{0}')}))"
_E = fn.ERF
_TAIL = f"0.5 * (1 / (1 + {_E['p']} * abs({{0}}) / sqrt(2.0))) * ((((({_E['a'][4]} * (1 / (1 + {_E['p']} * abs({{0}}) / sqrt(2.0))) + {_E['a'][3]}) * (1 / (1 + {_E['p']} * abs({{0}}) / sqrt(2.0))) + {_E['a'][2]}) * (1 / (1 + {_E['p']} * abs({{0}}) / sqrt(2.0))) + {_E['a'][1]}) * (1 / (1 + {_E['p']} * abs({{0}}) / sqrt(2.0))) + {_E['a'][0]})) * exp(-({{0}}) * ({{0}}) / 2)"
_CDF = f"(case when {{0}} >= 0 then 1 - {_TAIL} else {_TAIL} end)"


@query("probability_math", with_(QUOTES_SQL, f"""q as (select l_orderkey, l_linenumber, 1 / {_DEC} as p, line, (home_score - away_score) * 1.0 as mu from quotes where market = 'spread'),
    z as (select *, 1 / (1 + exp(-(0.1 + 0.9 * {_LOGIT.format('p')}))) as cal, (line - mu) / 13.0 as z, (line - 0.5 - mu) / 13.0 as zl, (line + 0.5 - mu) / 13.0 as zh from q)
    select l_orderkey, l_linenumber, round({_LOGIT.format('p')}, 6) as logit, round(cal, 6) as calibrated, round(1 / (1 + exp(-({_LOGIT.format('cal')} + 0.3 * (0 - {_LOGIT.format('cal')})))), 6) as pooled,
           round(case when abs(line - round(line)) <= 1e-9 then (1 - {_CDF.format('zh')}) / (1 - {_CDF.format('zh')} + {_CDF.format('zl')}) else 1 - {_CDF.format('z')} end, 6) as p_above from z"""))
def probability_math(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).where("market = 'spread'").select("l_orderkey", "l_linenumber", fn.break_even("price").alias("p"), "line", (F.col("home_score") - F.col("away_score")).cast("double").alias("mu"))
    cal = fn.calibrated_probability("p", 0.1, 0.9)
    return q.select("l_orderkey", "l_linenumber", r6(fn.logit("p")).alias("logit"), r6(cal).alias("calibrated"), r6(fn.pooled_probability(0.5, cal, 0.3)).alias("pooled"), r6(fn.above_probability("mu", "line", 13.0)).alias("p_above"))


@query("rating_math", with_("g as (select o_orderkey, o_totalprice % 400 + 1300 as a, o_totalprice % 317 + 1300 as b, o_orderkey % 41 - 20 as m, o_orderkey % 3 as c from orders)", """s as (select *, 1 / (1 + pow(10, (b - (a + 48)) / 400)) as p from g)
    select o_orderkey, round(p, 6) as p_home, round(least(2.5, 1 + pow(abs(m) / 6.0, 2)), 6) as multiplier, round(a + (1500 - a) / 3, 6) as carried, case when c = 0 then round(greatest(-60, least(60, (m / 100.0) * 100)), 6) else 0.0 end as adjustment from s"""))
def rating_math(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice % 400 + 1300 as a", "o_totalprice % 317 + 1300 as b", "o_orderkey % 41 - 20 as m", "o_orderkey % 3 as c")
    state = F.when(F.col("c") == 0, "CONFIRMED_PRE_CUTOFF").otherwise("AMBIGUOUS")
    return g.select("o_orderkey", r6(fn.home_probability("a", "b", 48.0)).alias("p_home"), r6(fn.margin_multiplier("m")).alias("multiplier"), r6(fn.carried_rating("a")).alias("carried"), r6(fn.entity_adjustment("c", state, F.col("m") / 100.0)).alias("adjustment"))


_EDGE = "(case market when 'moneyline' then case side when 'home' then home_score - away_score else away_score - home_score end when 'spread' then case side when 'home' then home_score - away_score else away_score - home_score end + line else case side when 'over' then home_score + away_score - line else line - home_score - away_score end end)"
_LEDGER_SQL = f"""ledger as (select *, {_DEC} as dec, case when abs(edge) < 1e-9 then 'PUSH' when edge > 0 then 'WIN' else 'LOSS' end as settled,
    case when abs(edge) < 1e-9 then 0.0 when edge > 0 then {_DEC} - 1 else -1.0 end as profit from (select *, {_EDGE} as edge from quotes))"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf).withColumn("price_decimal", fn.american_to_decimal("price"))
    return q.withColumns({"settled": fn.settlement("market", "side", "line", "home_score", "away_score"), "grade": fn.graded("market", "side", "line", "home_score", "away_score", "price_decimal")}).withColumn("profit", F.col("grade.profit"))


@query("grade_bets", with_(QUOTES_SQL, _LEDGER_SQL, "select l_orderkey, l_linenumber, settled, settled = 'WIN' as win, settled = 'PUSH' as push, round(profit, 6) as profit from ledger"))
def grade_bets(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).select("l_orderkey", "l_linenumber", "settled", "grade.win", "grade.push", r6("profit").alias("profit"))


@query("value_math", with_(QUOTES_SQL, f"""v as (select *, {_DEC} as dec, (game % 89 + 5) / 100.0 as q, (game % 5 + 0.5) / (200 + 1.0) as tie from quotes),
    w as (select *, (1 - tie) * q as pw, (1 - tie) * (1 - q) as pl from v)
    select l_orderkey, l_linenumber, round(pw * (dec - 1) - pl, 6) as value, round(1 + pl / pw, 6) as fair, case market when 'total' then line - 50 when 'spread' then case side when 'home' then -(3 + line) else line - 3 end else case side when 'home' then null end end as threshold,
           case when side in ('home', 'over') then 'gt' else 'lt' end as direction from w"""))
def value_math(spark: SparkSession, sf: str) -> DataFrame:
    v = quotes(spark, sf).withColumns({"q": (F.col("game") % 89 + 5) / 100.0, "ties": F.col("game") % 5})
    w = v.withColumn("t", fn.with_ties("q", "ties", 200))
    predicted = F.when(F.col("market") == "total", 50.0).otherwise(3.0)
    return w.select("l_orderkey", "l_linenumber", r6(fn.three_way_value("t.win", "t.loss", "price")).alias("value"), r6(fn.fair_decimal("t.win", "t.loss")).alias("fair"), fn.residual_threshold("market", "side", predicted, "line").alias("threshold"), fn.residual_direction("side").alias("direction"))


_BOARD_SQL = f"""board as (select *, {_DEC} as dec, cast(game % 700 as bigint) as support, case when game % 11 = 0 then null else (game % 60) / 1000.0 end as radius, (game % 23) / 200.0 as distance, (l_orderkey % 20) / 100.0 as disagreement, game % 7 <> 0 as stable, (game % 89 + 5) / 100.0 as q from quotes),
    tiers as (select *, case when distance > 0.10 then 'UNSUPPORTED' when support < 128 or not stable or radius is null then 'LOW' when support >= 512 and radius > 0 and radius <= 0.025 and disagreement <= 0.08 then 'HIGH' when support >= 256 and radius > 0 and radius <= 0.045 and disagreement <= 0.15 then 'MEDIUM' else 'LOW' end as tier from board),
    conf as (select *, case tier when 'HIGH' then 1.0 when 'MEDIUM' then 0.7 when 'LOW' then 0.35 else 0.0 end * coalesce(greatest(0, 1 - least(1, radius / 0.1)), 0) as k, q * (dec - 1) - (1 - q) as ev from tiers),
    lim as (select *, case when tier <> 'UNSUPPORTED' then least(0.99, q + 0.015 * k) end as qp from conf),
    play as (select *, case when tier = 'UNSUPPORTED' then 'UNSUPPORTED' when ev > 0 then 'VALUE' when 1 / dec <= qp + 1e-12 then 'PLAYABLE' else 'LEAN' end as status from lim)"""


def board(spark: SparkSession, sf: str) -> DataFrame:
    b = quotes(spark, sf).selectExpr("*", "cast(game % 700 as bigint) as support", "case when game % 11 = 0 then null else (game % 60) / 1000.0D end as radius", "(game % 23) / 200.0D as distance", "(l_orderkey % 20) / 100.0D as disagreement", "game % 7 <> 0 as stable", "(game % 89 + 5) / 100.0D as q")
    b = b.withColumn("tier", fn.reliability_tier("support", "radius", "distance", "disagreement", "stable")).withColumn("value", fn.three_way_value("q", 1 - F.col("q"), "price"))
    play = fn.play_through(F.lit(True), "value", "q", fn.break_even("price"), "tier", "radius")
    return b.withColumn("play", play).withColumns({"status": F.col("play.status"), "reason": fn.unsupported_reason("distance")})


@query("reliability_math", with_(QUOTES_SQL, _BOARD_SQL, """select l_orderkey, l_linenumber, tier, status, round(greatest(0.01, least(0.99, 0.5 + k * (q - 0.5))), 9) as staking, round(qp, 9) as play_break_even from play"""))
def reliability_math(spark: SparkSession, sf: str) -> DataFrame:
    return board(spark, sf).select("l_orderkey", "l_linenumber", "tier", "status", F.round(fn.staking_probability("q", 0.5, "tier", "radius"), 9).alias("staking"), F.round("play.break_even", 9).alias("play_break_even"))


@query("market_summary", with_(QUOTES_SQL, _BOARD_SQL, """select market, count(*) as n, count(*) filter (tier <> 'UNSUPPORTED') as n_supported, count(*) filter (tier = 'HIGH') as n_high, count(*) filter (status = 'VALUE') as n_value, count(*) filter (distance > 0.1) as n_out_of_support from play group by 1"""))
def market_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = offers.market_summary(board(spark, sf))
    n = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    return s.select("market", "n", "n_supported", n("by_tier", "HIGH").alias("n_high"), n("by_status", "VALUE").alias("n_value"), n("by_reason", "out_of_support").alias("n_out_of_support"))


@query("contribution_split", with_(QUOTES_SQL, _LEDGER_SQL, """b as (select *, case season % 3 when 0 then -1.0 when 1 then 0.0 else 1.0 end as coef, (game % 89 + 5) / 100.0 * (dec - 1) - (1 - (game % 89 + 5) / 100.0) as ev from ledger),
    s as (select *, case when coef > 0 then 'positive' when coef < 0 then 'negative' else 'zero' end as coefficient_sign, case when ev > 0 then 'positive' when ev < 0 then 'negative' else 'zero' end as value_sign from b)
    select coefficient_sign, value_sign, count(*) as n, round(sum(profit), 4) as profit, count(*) filter (profit > 0) as wins from s group by 1, 2"""))
def contribution_split(spark: SparkSession, sf: str) -> DataFrame:
    b = ledger(spark, sf).withColumn("value", fn.three_way_value((F.col("game") % 89 + 5) / 100.0, 1 - (F.col("game") % 89 + 5) / 100.0, "price"))
    coefficients = b.select("season").distinct().selectExpr("season", "case season % 3 when 0 then -1.0D when 1 then 0.0D else 1.0D end as coefficient")
    return offers.contribution_split(b, coefficients, ["season"]).select("coefficient_sign", "value_sign", "n", F.round("profit", 4).alias("profit"), "wins")


_BEST_SQL = f"best as (select *, row_number() over (partition by game, market, side order by case market when 'moneyline' then 0 else case side when 'over' then -line else line end end desc, price desc, {_RANK}, book, l_orderkey, l_linenumber) as k from quotes)"


@query("best_offer", with_(QUOTES_SQL, _BEST_SQL, "select game, market, side, line, price, book from best where k = 1"))
def best_offer(spark: SparkSession, sf: str) -> DataFrame:
    return offers.best_offers(quotes(spark, sf), ["game", "market", "side"], BOOKS).select("game", "market", "side", "line", "price", "book")


@query("max_price_offer", with_(QUOTES_SQL, "select game, book, market, side, max(price) as price, max_by(line, (price, line)) as line from quotes where market <> 'moneyline' group by 1, 2, 3, 4"))
def max_price_offer(spark: SparkSession, sf: str) -> DataFrame:
    return offers.max_price_offers(quotes(spark, sf).where("market <> 'moneyline'"), ["game", "book", "market", "side"], "price", ["line"])


@query("two_book_required", with_(QUOTES_SQL, "select game, market from quotes where book in ('b0', 'b3', 'b5') group by 1, 2 having count(distinct book) = 3"))
def two_book_required(spark: SparkSession, sf: str) -> DataFrame:
    return offers.quoted_by_all(quotes(spark, sf), ["game", "market"], "book", ["b0", "b3", "b5"])


@query("mirror_quotes", with_(QUOTES_SQL, """m as (select game, case side when 'away' then -line else line end + 0.0 as line, max(price) filter (side = 'home') as ph, max(price) filter (side = 'away') as pa from quotes where market = 'spread' group by 1, 2),
    b as (select * from m where ph is not null and pa is not null)
    select game, min(line) as line, min(ph) as price_home, min(pa) as price_away from b group by game having count(*) = 1"""))
def mirror_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return offers.mirrored_quotes(quotes(spark, sf).where("market = 'spread'"), ["game"], ("home", "away"), opposite=True)


@query("exact_offer_join", with_(QUOTES_SQL, _BEST_SQL, "select q.l_orderkey, q.l_linenumber, b.book as best_book, b.price as best_price from quotes q left join best b on b.k = 1 and b.game = q.game and b.market = q.market and b.side = q.side and b.line is not distinct from q.line"))
def exact_offer_join(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    best = offers.best_offers(q, ["game", "market", "side"], BOOKS).select("game", "market", "side", "line", F.col("book").alias("best_book"), F.col("price").alias("best_price"))
    return offers.exact_offers(q, best, ["game", "market", "side"]).select("l_orderkey", "l_linenumber", "best_book", "best_price")


@query("offer_flags", with_(QUOTES_SQL, _BEST_SQL, """j as (select q.*, b.line as bl, b.price as bp, case when q.market = 'moneyline' then 0.0 else case q.side when 'over' then -1 else 1 end * (q.line - b.line) end as gap from quotes q left join best b on b.k = 1 and b.game = q.game and b.market = q.market and b.side = q.side and b.book = 'b3')
    select l_orderkey, l_linenumber, gap > 0 and bp is not null as better_number, gap = 0 and price > bp as better_price, gap > 0 and price > bp as better_both, not (gap > 0 and bp is not null or gap = 0 and price > bp) as worse_or_equal, case when price > bp then 'BETTER' when price = bp then 'EQUAL' when price < bp then 'WORSE' end as compared from j where bp is not null"""))
def offer_flags(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    best = offers.best_offers(q, ["game", "market", "side"], BOOKS).where("book = 'b3'").select("game", "market", "side", F.col("line").alias("bl"), F.col("price").alias("bp"))
    j = q.join(best, ["game", "market", "side"])
    return j.select("l_orderkey", "l_linenumber", fn.offer_flags("market", "side", "line", "price", "bl", "bp").alias("f"), fn.compared("price", "bp").alias("compared")).select("l_orderkey", "l_linenumber", "f.*", "compared")


@query("coverage_matrix", with_(QUOTES_SQL, """p as (select book, game, bool_or(market = 'moneyline') as m, bool_or(market = 'spread') as s, bool_or(market = 'total') as t from quotes group by 1, 2)
    select book, count(*) filter (m) as n_moneyline, count(*) filter (s) as n_spread, count(*) filter (t) as n_total, count(*) filter (m and s and t) as n_complete from p group by 1"""))
def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return offers.coverage(quotes(spark, sf), "book", "market", "game", list(offers.MARKETS))


@query("books_histogram", with_(QUOTES_SQL, "p as (select game, count(distinct book) as n_distinct from quotes group by 1) select n_distinct, count(*) as n_groups from p group by 1").replace("),\np as", "),\np as"))
def books_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return offers.distinct_histogram(quotes(spark, sf), ["game"], "book")


@query("game_presence", with_(QUOTES_SQL, """p as (select game, book, count(distinct market) as k, bool_or(market = 'moneyline') as m, bool_or(market = 'spread') as s, bool_or(market = 'total') as t from quotes group by 1, 2)
    select game, bool_or(m) as has_moneyline, bool_or(s) as has_spread, bool_or(t) as has_total, count(*) as n_books, coalesce(array_to_string(list_sort(list(book) filter (k = 3)), ','), '') as complete_books, cast(count(*) filter (k = 3) as int) as n_complete_books from p group by 1"""))
def game_presence(spark: SparkSession, sf: str) -> DataFrame:
    out = offers.game_presence(quotes(spark, sf), "game", "book", "market", list(offers.MARKETS))
    return out.withColumn("complete_books", F.array_join("complete_books", ","))


@query("quality_flags", with_(QUOTES_SQL, """p as (select game, book, market, count(*) as n, count(*) filter (abs(price) = 100) as bad from quotes group by 1, 2, 3),
    g as (select game, not bool_or(market = 'moneyline' and n > bad) as m, not bool_or(market = 'spread' and n > bad) as s, not bool_or(market = 'total' and n > bad) as t, sum(bad) > 0 as bad, max(n) > 1 as dup from p group by 1)
    select game, concat_ws(',', case when dup then 'DUPLICATE' end, case when bad then 'MALFORMED' end, case when m then 'MISSING_moneyline' end, case when s then 'MISSING_spread' end, case when t then 'MISSING_total' end) as flags from g"""))
def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = offers.quality_flags(quotes(spark, sf), "game", "book", "market", F.abs("price") != 100, list(offers.MARKETS))
    return out.withColumn("flags", F.array_join("flags", ","))


_SUMMARY = "count(profit) as n, count(*) filter (profit > 0) as wins, count(*) filter (profit < 0) as losses, count(*) filter (profit = 0) as pushes, round(count(*) filter (profit > 0) / nullif(count(*) filter (profit <> 0), 0), 6) as hit_rate, round(avg(dec), 6) as mean_price, round(avg(1 / dec), 6) as break_even, round(sum(profit), 4) as profit, round(sum(profit) / count(profit), 6) as roi, count(distinct month) as n_blocks"


@query("ledger_summary_grouping_sets", with_(QUOTES_SQL, _LEDGER_SQL, f"""select market, season, case grouping(market, season) when 0 then 'market+season' when 1 then 'market' when 2 then 'season' else 'ALL' end as grain, {_SUMMARY} from ledger group by grouping sets ((market, season), (market), ())"""))
def ledger_summary_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    out = offers.summaries(ledger(spark, sf), [["market", "season"], ["market"], []], offers.summary(block="month"))
    return out.withColumns({c: F.round(c, 4 if c == "profit" else 6) for c in ("hit_rate", "mean_price", "break_even", "profit", "roi")})


@query("dim_season_matrix", with_(QUOTES_SQL, "select market, side, count(*) filter (season = 1996) as s1996, count(*) filter (season = 1997) as s1997, count(*) as total, count(*) filter (season not in (1996, 1997)) as other from quotes group by 1, 2"))
def dim_season_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return offers.count_matrix(quotes(spark, sf), ["market", "side"], "season", [1996, 1997])


@query("running_profit", with_(QUOTES_SQL, _LEDGER_SQL, """select l_orderkey, l_linenumber, count(*) over w as bet_no, count(*) filter (profit > 0) over w as cum_wins, round(sum(profit) over w, 4) as cum_profit from ledger window w as (partition by book, season order by month, l_orderkey, l_linenumber, game, price rows between unbounded preceding and current row)"""))
def running_profit(spark: SparkSession, sf: str) -> DataFrame:
    out = offers.running_profit(ledger(spark, sf), ["book", "season"], ["month", "l_orderkey", "l_linenumber", "game", "price"])
    return out.select("l_orderkey", "l_linenumber", "bet_no", "cum_wins", F.round("cum_profit", 4).alias("cum_profit"))


@query("concentration", with_(QUOTES_SQL, _LEDGER_SQL, """p as (select game, sum(profit) as s, count(*) as n from ledger group by 1), w as (select sum(s) as worst from (select s from p where s < 0 order by s, game limit 3))
    select max_by(game, (abs(s), game)) as largest, round(max_by(s, (abs(s), game)), 4) as largest_value, max_by(game, (n, game)) as most_rows, round((select worst from w) / sum(least(s, 0)), 6) as top_loss_share from p"""))
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    out = offers.concentration(ledger(spark, sf), "game", "profit")
    return out.withColumns({"largest_value": F.round("largest_value", 4), "top_loss_share": r6("top_loss_share")})


@query("set_overlap", with_(QUOTES_SQL, """p as (select game, market, bool_or(book = 'b0') as a, bool_or(book = 'b1') as b from quotes group by 1, 2)
    select count(*) filter (a) as n_a, count(*) filter (b) as n_b, count(*) filter (a and b) as n_both, count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b, round(count(*) filter (a and b) / count(*) filter (a or b), 6) as jaccard from p"""))
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return offers.set_overlap(quotes(spark, sf), ["game", "market"], "book", "b0", "b1").withColumn("jaccard", r6("jaccard"))


@query("quantiles_age", """with q as (select event_type, (epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 60e6 as age from events)
    select event_type, count(age) as n, round(min(age), 4) as min_age, round(median(age), 4) as median_age, round(quantile_cont(age, 0.9), 4) as p90_age, round(max(age), 4) as max_age from q group by 1""")
def quantiles_age(spark: SparkSession, sf: str) -> DataFrame:
    out = offers.quote_ages(load(spark, sf, "events").withColumn("snapshot", F.lit("2024-02-01").cast("timestamp")), ["event_type"], "ts", "snapshot")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("_age")})


@query("zone_buckets", with_(QUOTES_SQL, _LEDGER_SQL, """b as (select *, 1 / dec as q, case when price < -150 then 'heavy' when price < 0 then 'favourite' when price < 150 then 'even' else 'dog' end as band from ledger)
    select band, count(*) as n, count(*) filter (q between 0.25 and 0.45 and price between 130 and 240) as n_zone, round(sum(profit), 4) as profit from b group by 1"""))
def zone_buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = ledger(spark, sf).withColumns({"band": fn.bucket("price", [-150, 0, 150], ["heavy", "favourite", "even", "dog"]), "zone": fn.in_zone(fn.break_even("price"), "price", (0.25, 0.45), (130, 240))})
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if("zone").alias("n_zone"), F.round(F.sum("profit"), 4).alias("profit"))


@query("corroborated_side", with_(QUOTES_SQL, """v as (select game, market, book, max_by(side, (price, side)) as side, max(price) as price from quotes group by 1, 2, 3),
    w as (select game, market, max(side) filter (book = 'b0') as side, max(side) filter (book = 'b1') as s2, max(price) filter (book = 'b2') as price from v group by 1, 2)
    select game, market, side, price from w where side = s2 and price is not null"""))
def corroborated_side(spark: SparkSession, sf: str) -> DataFrame:
    v = quotes(spark, sf).groupBy("game", "market", "book").agg(F.max_by("side", F.struct("price", "side")).alias("side"), F.max("price").alias("price"))
    return offers.corroborated(v, ["game", "market"], "book", "side", "price", ("b0", "b1"), "b2")


@query("residual_probabilities", with_(QUOTES_SQL, """res as (select distinct game, season, (home_score - away_score) - (game % 9 - 4) as residual from quotes), rr as (select game, min(season) as block_ord, min(residual) as residual from res group by 1),
    o as (select row_number() over () as rid, l_orderkey, l_linenumber, side, season as block_ord, (game % 9 - 4) * 1.0 as predicted, line, case side when 'home' then -((game % 9 - 4) + line) else line - (game % 9 - 4) end as t, abs(line - round(line)) <= 1e-9 as push from quotes where market = 'spread'),
    c as (select o.rid, count(r.game) as n, count(*) filter (case when push then case side when 'home' then residual >= t + 0.5 else residual < t - 0.5 end else case side when 'home' then residual > t else residual < t end end) as w,
          count(*) filter (push and residual >= t - 0.5 and residual < t + 0.5) as p from o join rr r on r.block_ord < o.block_ord group by 1)
    select o.l_orderkey, o.l_linenumber, round((w + 0.5) / (n + case when push then 1.5 else 1.0 end), 6) as p_win, round(case when push then (p + 0.5) / (n + 1.5) when n is not null then 0.0 end, 6) as p_push, round((n - w - p + 0.5) / (n + case when push then 1.5 else 1.0 end), 6) as p_loss
    from o left join c using (rid)"""))
def residual_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes(spark, sf)
    residuals = q.groupBy("game").agg(F.min("season").alias("block_ord"), F.min((F.col("home_score") - F.col("away_score")) - (F.col("game") % 9 - 4)).alias("residual"))
    o = q.where("market = 'spread'").select("l_orderkey", "l_linenumber", "market", "side", "line", F.col("season").alias("block_ord"), (F.col("game") % 9 - 4).cast("double").alias("predicted"))
    out = offers.residual_probabilities(o, residuals)
    return out.select("l_orderkey", "l_linenumber", r6("p_win").alias("p_win"), r6("p_push").alias("p_push"), r6("p_loss").alias("p_loss"))
