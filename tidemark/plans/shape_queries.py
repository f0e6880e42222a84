"""Projections, guarded joins, gates and composites that no other query reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import functions as fn
from tidemark import quality
from tidemark.functions.odds import ACKLAM, ERF
from tidemark.operators import evaluation as ev
from tidemark.operators import identity, offers, reshape, snapshots
from tidemark.plans import pipelines
from tidemark.plans.base import GAMES_SQL, PREDICTIONS_SQL, QUOTES_SQL, games, load, predictions, query, quotes, with_
from tidemark.plans.evaluation_queries import _SCORES
from tidemark.plans.offer_queries import _LEDGER_SQL, _SUMMARY, ledger


def r6(c: str) -> F.Column:
    return (F.round(c, 6) + 0.0).alias(c)


def counted(gate: DataFrame) -> DataFrame:
    """A gate's violations by name: how many, and the rows they concern."""
    return gate.groupBy("gate").agg(F.count(F.lit(1)).alias("violations"), F.sum("n").alias("rows"))


@query("sealed_rows", with_(GAMES_SQL, "select game, season from games where season <= 1996"))
def sealed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-08. A later season in these rows would fail the job."""
    return quality.sealed(games(spark, sf).where("season <= 1996").select("game", "season"), "season", 1996)


@query("forbidden_columns", """select 'forbidden' as gate, column_name as detail, 1 as n from (describe orders) where column_name = 'o_clerk' or column_name like '%price%' or column_name like '%date%'
    union all select 'utc', column_name || ' is ' || case column_type when 'DOUBLE' then 'double' else 'bigint' end, 1 from (describe events) where column_name in ('value', 'event_id')""")
def forbidden_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-09, DQ-04."""
    f = quality.forbidden_columns(load(spark, sf, "orders"), ["o_clerk"], ["price", "date"])
    return f.unionByName(quality.utc_columns(load(spark, sf, "events"), ["ts", "value", "event_id"])).withColumn("n", F.col("n").cast("int"))


@query("projected_columns", "select c_custkey as id, c_name as name, c_acctbal as balance from customer")
def projected_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-10."""
    return reshape.projected(load(spark, sf, "customer"), {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal"})


@query("context_columns", """select c_custkey, case when c_custkey % 4 <> 0 then c_acctbal end as rest, case when c_custkey % 4 = 0 then 1 else 0 end as rest_missing,
    case when c_custkey % 5 = 0 or c_custkey % 7 = 0 then 'unknown' else lower(c_mktsegment) end as roof from customer""")
def context_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-11."""
    c = load(spark, sf, "customer").selectExpr("c_custkey", "case when c_custkey % 4 <> 0 then c_acctbal end as rest", "case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then ' ' else c_mktsegment end as roof")
    return reshape.context(c, ["rest"], ["roof"])


@query("model_columns", "select o_orderkey, o_custkey, o_totalprice from orders")
def model_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-16. The columns of a prefix without text and without one that is left out."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return o.select(*reshape.model_columns(o, ["o_"], {"o_orderdate"}))


@query("outcome_free_rows", with_(GAMES_SQL, "select game, season, home, away, d.n as same_day, h.n as home_games from games left join (select day, count(*) as n from games group by 1) d using (day) left join (select home, count(*) as n from games group by 1) h using (home)"))
def outcome_free_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-19, JN-18. Games without their scores, with context by game."""
    g = games(spark, sf)
    by = lambda c, name: g.select("game", c).join(g.groupBy(c).agg(F.count(F.lit(1)).alias(name)), c).select("game", name)
    return reshape.outcome_free(g.select("game", "season", "home", "away", "home_score", "away_score"), ["home_score", "away_score"], [by("day", "same_day"), by("home", "home_games")], ["game"])


@query("warm_predictions", with_(PREDICTIONS_SQL, "select doc_id, case when week >= 3 then p end as p from predictions"))
def warm_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-20."""
    return predictions(spark, sf).select("doc_id", reshape.warm("p", F.col("week") < 3).alias("p"))


@query("standardised_columns", "select cast(c_custkey as varchar) as id, coalesce(case when c_custkey % 2 = 0 then c_mktsegment end, c_name) as label, cast(null as double) as weight from customer")
def standardised_columns(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-22."""
    c = load(spark, sf, "customer").selectExpr("c_custkey as id", "case when c_custkey % 2 = 0 then c_mktsegment end as phone", "c_name as name")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("weight", T.DoubleType())])
    return reshape.standardised(c, schema, {"label": ["phone", "gone", "name"]})


@query("side_by_side", "select coalesce(a.k, b.k, c.k) as k, a.n as orders, b.n as lines, c.n as customers from (select o_custkey % 500 as k, count(*) as n from orders group by 1) a full join (select l_suppkey % 600 as k, count(*) as n from lineitem group by 1) b on a.k = b.k full join (select c_nationkey as k, count(*) as n from customer group by 1) c on c.k = coalesce(a.k, b.k)")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """SO-04."""
    of = lambda t, k, name: load(spark, sf, t).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias(name))
    return reshape.side_by_side([of("orders", F.col("o_custkey") % 500, "orders"), of("lineitem", F.col("l_suppkey") % 600, "lines"), of("customer", F.col("c_nationkey"), "customers")], ["k"])


@query("canonical_side", with_(QUOTES_SQL, "select distinct game, book, market from quotes where side in ('home', 'over')"))
def canonical_side(spark: SparkSession, sf: str) -> DataFrame:
    """SO-06. One row of each mirrored pair."""
    return reshape.canonical_side(quotes(spark, sf), "side", ["home", "over"], ["game", "book", "market"]).select("game", "book", "market")


@query("guarded_join", """with l as (select o_orderkey as k, o_custkey as v from orders where o_orderkey % 6 <> 0), r as (select l_orderkey as k, l_linenumber as n from lineitem where l_linenumber <= 2 and (l_linenumber = 1 or l_orderkey % 10 = 0))
    select null as gate, count(*) as n, sum(v * n) as total from l join r using (k)
    union all select 'one_to_one:right', count(*), null from (select k from r group by 1 having count(*) > 1)
    union all select 'one_to_one', count(*), null from (select k from l where k not in (select k from r) union all select k from (select distinct k from r where k not in (select k from l)))""")
def guarded_join(spark: SparkSession, sf: str) -> DataFrame:
    """JN-08, DQ-01, DQ-03. A join that isn't one to one: its rows summed up, and its violations counted."""
    left = load(spark, sf, "orders").where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    right = load(spark, sf, "lineitem").where("l_linenumber <= 2 and (l_linenumber = 1 or l_orderkey % 10 = 0)").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    rows, gates = identity.guarded_join(left, right, ["k"])
    found = rows.agg(F.lit(None).cast("string").alias("gate"), F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * F.col("n")).cast("long").alias("total"))
    return found.unionByName(gates.groupBy("gate").agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


@query("canonical_names", """with m as (select o_custkey as g, 's' || (o_orderkey % 3) as source, min('canon ' || (o_orderkey % 3)) as canon, count(distinct case when o_orderkey % 40 = 1 then 'canon x' else 'canon ' || (o_orderkey % 3) end) as n from orders group by 1, 2),
    f as (select o_custkey as g, 's' || (o_orderkey % 3) as source, min(case when o_orderkey % 40 = 1 then 'canon x' else 'canon ' || (o_orderkey % 3) end) as canon from orders group by 1, 2), r as (select o_orderkey, o_custkey as g, 's' || (o_orderkey % 4) as name from orders)
    select r.o_orderkey, coalesce(f.canon, r.name) as name, null as gate, null as n from r left join f on f.g = r.g and f.source = r.name
    union all select null, null, 'alias_ambiguous', count(*) from m where n > 1 union all select null, null, 'alias_unknown', count(*) from (select distinct r.g, r.name from r where not exists (select 1 from f where f.g = r.g and f.source = r.name))""")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """JN-11. Names by their own group's mapping alone; ambiguous and unknown names are counted."""
    o = load(spark, sf, "orders")
    mapping = o.selectExpr("o_custkey as g", "concat('s', o_orderkey % 3) as source", "case when o_orderkey % 40 = 1 then 'canon x' else concat('canon ', o_orderkey % 3) end as canon").distinct()
    rows, gates = identity.canonical_names(o.selectExpr("o_orderkey", "o_custkey as g", "concat('s', o_orderkey % 4) as name"), mapping, "g", "name", "source", "canon")
    return rows.select("o_orderkey", "name").unionByName(gates.groupBy("gate").agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


@query("committed_rows", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def committed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """JN-20."""
    history = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    return snapshots.committed(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), history, "l_orderkey", done="F")


@query("overridden_rows", """with e as (select c_custkey as k, c_nationkey as v, c_acctbal < 0 as bad from customer), o as (select c_custkey as k, 99 as v from customer where c_acctbal < 0 and c_custkey % 5 <> 0 or c_custkey % 100 = 1 and c_acctbal >= 0)
    select e.k, case when bad then o.v else e.v end as v, null as violations from e left join o using (k)
    union all select null, null, count(*) from (select k from e where bad and k not in (select k from o) union all select k from o where k not in (select k from e where bad))""")
def overridden_rows(spark: SparkSession, sf: str) -> DataFrame:
    """JN-24. Exceptions take their override; overrides that are missing or uncalled for are counted."""
    c = load(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"), "c_acctbal")
    over = c.where("c_acctbal < 0 and c_custkey % 5 <> 0 or c_custkey % 100 = 1 and c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.lit(99).cast("long").alias("v"))
    fixed, gates = identity.overridden(rows, over, ["k"], "v", F.col("c_acctbal") < 0)
    return fixed.select("k", "v").unionByName(gates.agg(F.count(F.lit(1)).alias("violations")), allowMissingColumns=True)


@query("assembled_runs", """with h as (select o_orderkey as run_id, o_custkey as c from orders where o_orderstatus = 'O'), a as (select l_orderkey as run_id, count(*) as n, count(*) filter (l_returnflag = 'N') as s from lineitem where l_linenumber > 1 group by 1),
    r as (select l_orderkey as run_id, count(*) as n from lineitem where l_quantity > 25 group by 1), w as (select l_orderkey as run_id, count(*) filter (l_linestatus = 'O') as n from lineitem group by 1)
    select h.run_id, coalesce(a.n, 0) as n_attempts, coalesce(a.s, 0) as n_success, coalesce(r.n, 0) as n_rows, coalesce(w.n, 0) as n_matched from h left join a using (run_id) left join r using (run_id) left join w using (run_id)""")
def assembled_runs(spark: SparkSession, sf: str) -> DataFrame:
    """JN-25."""
    li = load(spark, sf, "lineitem").withColumn("run_id", F.col("l_orderkey"))
    history = load(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    attempts = li.where("l_linenumber > 1").select("run_id", F.when(F.col("l_returnflag") == "N", "success").otherwise("failed").alias("outcome"))
    walks = li.select("run_id", F.when(F.col("l_linestatus") == "O", "MATCHED").otherwise("UNMATCHED").alias("status"))
    out = snapshots.assembled_runs(history, attempts, li.where("l_quantity > 25").select("run_id"), walks, done="O")
    return out.select("run_id", "n_attempts", "n_success", "n_rows", "n_matched")


@query("per_season", with_(GAMES_SQL, "select season, count(*) as n, count(*) filter (home_score > away_score) as home_wins, count(*) filter (neutral) as neutral from games group by 1"))
def per_season(spark: SparkSession, sf: str) -> DataFrame:
    """AG-02."""
    return offers.per_season(games(spark, sf), "season", {"home_wins": F.col("home_score") > F.col("away_score"), "neutral": F.col("neutral")})


@query("scorecard", with_(PREDICTIONS_SQL, f"select source, lang, case grouping(source, lang) when 1 then 'source' when 2 then 'lang' else 'ALL' end as grain, {_SCORES} from predictions group by grouping sets ((source), (lang), ())"))
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """PL-12, AG-37. The metrics of a scorecard; its other parts have queries of their own."""
    card = pipelines.scorecard(predictions(spark, sf), "p", "y", ["source", "lang"], ["doc_id"])
    return card["metrics"].select("source", "lang", "grain", "n", *(r6(c) for c in ("brier", "log_loss", "accuracy")))


@query("scorecard_worst", with_(PREDICTIONS_SQL, "select doc_id, p, y from predictions order by pow(p - y, 2) desc, doc_id limit 20"))
def scorecard_worst(spark: SparkSession, sf: str) -> DataFrame:
    """PL-12, ST-02. The worst predictions of a scorecard."""
    return pipelines.scorecard(predictions(spark, sf), "p", "y", ["source"], ["doc_id"])["worst"].select("doc_id", "p", "y")


@query("zone_rows", with_(QUOTES_SQL, _LEDGER_SQL, f"select market, {_SUMMARY} from ledger where 1 / dec between 0.25 and 0.45 and price between 130 and 240 group by 1"))
def zone_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-14, AG-40. The summary of a locked zone."""
    rows = ledger(spark, sf).withColumn("q", fn.break_even("price"))
    out = pipelines.zone_rows(rows, "q", "price", (0.25, 0.45), (130, 240)).groupBy("market").agg(*offers.summary(block="month"))
    return out.withColumns({c: F.round(c, 4 if c == "profit" else 6) for c in ("hit_rate", "mean_price", "break_even", "profit", "roi")})


def _poly_sql(x: str, coefficients: tuple[float, ...]) -> str:
    return reduce(lambda a, c: f"({a}) * {x} + ({c!r}::double)", coefficients[1:], f"({coefficients[0]!r}::double)")


_CDF_SQL = f"case when z >= 0 then 1 - tail else tail end as cdf from (select *, 0.5 * t * ({_poly_sql('t', ERF['a'][::-1])}) * exp(-x * x) as tail from (select *, 1 / (1 + {ERF['p']} * x) as t from (select *, abs(z) / sqrt(2.0) as x from q)))"


@query("normal_functions", with_("q as (select event_id, (event_id % 801 - 400) / 100.0::double as z, (event_id % 981 + 10) / 1000.0::double as p, event_id % 40 as l from events)", f"""c as (select event_id, {_CDF_SQL}),
    i as (select event_id, l, case when p < {ACKLAM['low']} then ({_poly_sql('lo', ACKLAM['c'])}) / (({_poly_sql('lo', ACKLAM['d'])}) * lo + 1) when p <= {1 - ACKLAM['low']} then ({_poly_sql('r', ACKLAM['a'])}) * m / (({_poly_sql('r', ACKLAM['b'])}) * r + 1) else -({_poly_sql('hi', ACKLAM['c'])}) / (({_poly_sql('hi', ACKLAM['d'])}) * hi + 1) end as inv
        from (select *, sqrt(-2 * ln(p)) as lo, sqrt(-2 * ln(1 - p)) as hi, p - 0.5 as m, (p - 0.5) * (p - 0.5) as r from q))
    select event_id, round(cdf, 6) as cdf, round(inv, 6) as inverse, case when l % 2 = 1 then round(l / 2.0 + 13.0 * inv, 5) end as implied_mean from c join i using (event_id)"""))
def normal_functions(spark: SparkSession, sf: str) -> DataFrame:
    """FN-07, FN-09."""
    e = load(spark, sf, "events").selectExpr("event_id", "(event_id % 801 - 400) / 100.0D as z", "(event_id % 981 + 10) / 1000.0D as p", "event_id % 40 / 2.0D as line")
    return e.select("event_id", F.round(fn.normal_cdf("z"), 6).alias("cdf"), F.round(fn.normal_inverse("p"), 6).alias("inverse"), F.round(fn.implied_mean("line", "p", F.lit(13.0)), 5).alias("implied_mean"))


@query("scalar_targets", with_(GAMES_SQL, """g as (select *, case when game % 6 <> 0 then home_score end as hs from games)
    select game, round(case when game % 2 = 0 then (game % 97) / 97.0 else 1 - (game % 97) / 97.0 end, 6) as p_side, hs is not null as available, case when hs <> away_score then hs > away_score end as home_win, coalesce(hs = away_score, false) as tie, hs - away_score as margin,
        case game % 5 + 1 when 1 then 1 when 2 then 1 when 3 then 2 when 4 then 2 else 3 end as half, cast(game % 3 as int) as stage, round(cast(hs as double) / nullif(away_score, 0), 6) as ratio from g"""))
def scalar_targets(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-12, PRJ-15, FN-32, FN-34."""
    g = games(spark, sf).withColumn("hs", F.when(F.col("game") % 6 != 0, F.col("home_score")))
    side = F.when(F.col("game") % 2 == 0, "home").otherwise("away")
    stage = F.element_at(F.array(*map(F.lit, ("first", "second", "last"))), (F.col("game") % 3 + 1).cast("int"))
    return g.select("game", F.round(fn.oriented(side, (F.col("game") % 97) / 97.0), 6).alias("p_side"), fn.target("hs", "away_score").alias("t"), fn.half_of_period(F.col("game") % 5 + 1).alias("half"), fn.stage_rank(stage, ["first", "second", "last"]).alias("stage"), F.round(fn.ratio("hs", "away_score"), 6).alias("ratio")).select("game", "p_side", "t.*", "half", "stage", "ratio")


@query("fingerprint_check", """select count(*) as n_rows, sha256((select string_agg(column_name || ':' || case column_type when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else 'timestamp' end, ',' order by column_name) from (describe orders))) as schema_sha256,
    true as same_reordered, false as same_changed from orders""")
def fingerprint_check(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-05, SNK-05, DQ-13. The fingerprint stays as it is when rows change places, and not when one value changes."""
    o = load(spark, sf, "orders")
    least = o.agg(F.min("o_orderkey").alias("_least"))  # one row
    changed = o.crossJoin(least).withColumn("o_custkey", F.when(F.col("o_orderkey") == F.col("_least"), F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).select(*o.columns)
    a, b, c = (quality.fingerprint(df).select(F.col("content").alias(f"c{k}"), *(["n_rows", "schema_sha256"] if not k else [])) for k, df in enumerate((o, o.repartition(7, "o_custkey"), changed)))
    return a.crossJoin(b).crossJoin(c).select("n_rows", "schema_sha256", (F.col("c0") == F.col("c1")).alias("same_reordered"), (F.col("c0") == F.col("c2")).alias("same_changed"))


@query("outcome_gate", with_(GAMES_SQL, "select 'invariant' as gate, 1 as violations, count(*) filter (home_score <> away_score and game % 9 = 0 or home_score = away_score and game % 4 = 0) as rows from games"))
def outcome_gate(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-06, DQ-15. Games whose win flag was turned, or whose tie flag was dropped."""
    g = games(spark, sf).select("game", (F.col("home_score") - F.col("away_score")).alias("margin"))
    win = F.when(F.col("margin") != 0, (F.col("margin") > 0) != (F.col("game") % 9 == 0))
    rows = g.select("margin", win.alias("win"), ((F.col("margin") == 0) & (F.col("game") % 4 != 0)).alias("tie"))
    return counted(quality.invariants(rows, quality.outcome_rules("win", "tie", "margin"))).withColumn("violations", F.col("violations").cast("int"))


@query("pairs_gate", with_(GAMES_SQL, "select 'pairs' as gate, count(*) as violations, count(*) as rows from games where game % 7 = 0 or game % 11 = 0"))
def pairs_gate(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-07. Games that lack a side, or whose changes don't sum to zero."""
    g = games(spark, sf)
    rows = g.select("game", F.explode(F.when(F.col("game") % 7 == 0, F.array(F.lit("home"))).otherwise(F.array(F.lit("home"), F.lit("away")))).alias("side"))
    change = F.when(F.col("side") == "home", F.lit(2.5)).otherwise(F.when(F.col("game") % 11 == 0, -2.0).otherwise(-2.5))
    return counted(quality.pairs(rows.withColumn("change", change), ["game"], "side", ("home", "away"), "change"))


@query("complete_blocks_gate", """with e as (select o_orderkey as k from orders where o_orderkey % 5 <> 1), o as (select l_orderkey as k, count(*) as n from lineitem where l_linenumber <= 2 and l_quantity > 20 group by 1)
    select 'complete' as gate, count(*) as violations, cast(sum(coalesce(n, 0)) as bigint) as rows from e full join o using (k) where n is null or n <> 1 or k % 5 = 1""")
def complete_blocks_gate(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-08."""
    want = load(spark, sf, "orders").where("o_orderkey % 5 <> 1").select(F.col("o_orderkey").alias("k"))
    seen = load(spark, sf, "lineitem").where("l_linenumber <= 2 and l_quantity > 20").select(F.col("l_orderkey").alias("k"))
    return counted(quality.complete_blocks(want, seen, ["k"]))


@query("leakage_counts", """with j as (select l_shipdate as d, o_orderdate as cut, l_linenumber = 3 as same from lineitem join orders on o_orderkey = l_orderkey)
    select count(*) filter (d <= cut + interval 40 day and not same) as n_eligible, count(*) filter (d > cut + interval 40 day) as n_after_cutoff, count(*) filter (same) as n_same_event from j""")
def leakage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-10."""
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    facts = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_shipdate").alias("at"), (F.col("o_orderdate") + F.expr("interval 40 days")).alias("cut"), "l_linenumber")
    return quality.leakage(facts, "at", "cut", F.col("l_linenumber") == 3)


@query("equal_ledgers_gate", """select 'equal' as gate, unnest(['column price', 'column status', 'key on one side']) as detail, unnest([count(*) filter (o_orderkey % 8 = 0 and o_orderkey % 9 <> 0), count(*) filter (o_orderkey % 13 = 0 and o_orderkey % 9 <> 0), count(*) filter (o_orderkey % 9 = 0)]) as n from orders""")
def equal_ledgers_gate(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-11, DQ-14. A ledger against a copy with other prices, cleared states and rows left out."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    other = o.where("k % 9 <> 0").select("k", F.when(F.col("k") % 8 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(F.col("k") % 13 != 0, F.col("status")).alias("status"))
    return quality.equal_ledgers(o, other, ["k"])


@query("expected_counts_gate", with_(GAMES_SQL, """x as (select season, count(*) as n from games group by 1), w(season, want) as (values (1992, -1), (1993, -1), (2040, 5)), v as (select coalesce(x.season, w.season) as season, coalesce(n, 0) as have, coalesce(case want when -1 then n else want end, 0) as want from x full join w using (season))
    select season || ': expected ' || want as detail, have as n from v where have <> want"""))
def expected_counts_gate(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-12. Two seasons have the expected number of games; one that is expected isn't there, and the others are not expected."""
    g = games(spark, sf)
    right = {r.season: r.n for r in g.where("season in (1992, 1993)").groupBy("season").agg(F.count(F.lit(1)).alias("n")).collect()}
    return quality.expected_counts(g, "season", right | {2040: 5}).select("detail", "n")


@query("changed_summaries", "with a as (select o_orderpriority as k, count(*) as n, sum(o_custkey) as s from orders where o_orderkey % 2 = 0 group by 1), b as (select o_orderpriority as k, count(*) as n, sum(o_custkey) as s from orders where o_orderpriority <> '1-URGENT' group by 1) select coalesce(a.k, b.k) as k, a.n as n_before, b.n as n_after, a.s as s_before, b.s as s_after, coalesce(b.n, 0) - coalesce(a.n, 0) as n_delta, coalesce(b.s, 0) - coalesce(a.s, 0) as s_delta from a full join b using (k)")
def changed_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-16."""
    of = lambda df: df.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))
    o = load(spark, sf, "orders")
    return quality.changed_summaries(of(o.where("o_orderkey % 2 = 0")), of(o.where("o_orderpriority <> '1-URGENT'")), ["k"])


@query("finite_gate", "select 'finite' as gate, 'c_name is string' as detail, 1 as n union all select 'finite', 'ratio', count(*) filter (c_nationkey = 0) from customer")
def finite_gate(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-18."""
    c = load(spark, sf, "customer").select("c_name", "c_acctbal", F.when(F.col("c_nationkey") == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("ratio"))
    return quality.finite(c, ["c_name", "c_acctbal", "ratio"])


@query("actual_entering", with_(GAMES_SQL, """st as (select 'c' || (l_partkey % 300) as player, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) as block_ord, case when l_linenumber <> 4 then l_discount * 10 - 0.5 end as value, cast(l_quantity as bigint) - 10 as volume from lineitem),
    pb as (select player, block_ord, sum(value * greatest(volume, 1)) as num, sum(greatest(volume, 1)) as den, sum(volume) as n from st where value is not null group by 1, 2),
    sd as (select game, block_ord, s.side, 'c' || ((game + s.k) % 300) as player from games, (values ('home', 0), ('away', 7)) s(side, k)),
    x as (select sd.game, sd.side, sum(num) as num, sum(den) as den, sum(n) as n from sd left join pb on pb.player = sd.player and pb.block_ord < sd.block_ord group by 1, 2)
    select game, side, round(case when num is null then -0.05 else n / (n + 250.0) * num / den + 250.0 / (n + 250.0) * -0.05 end, 6) as shrunk_value from x"""))
def actual_entering(spark: SparkSession, sf: str) -> DataFrame:
    """PL-02. The starters' shrunk efficiency of earlier blocks."""
    g = games(spark, sf)
    stats = load(spark, sf, "lineitem").selectExpr("concat('c', l_partkey % 300) as player", "(year(l_shipdate) - 1990) * 12 + month(l_shipdate) as block_ord", "case when l_linenumber <> 4 then l_discount * 10 - 0.5D end as value", "cast(l_quantity as bigint) - 10 as volume")
    starters = g.select("game", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.concat(F.lit("c"), (F.col("game") + k) % 300).alias("player")) for s, k in (("home", 0), ("away", 7))))).alias("s")).select("game", "s.*")
    rows, _ = pipelines.actual_entering(g, stats, starters)
    return rows.select("game", "side", r6("shrunk_value"))


@query("modeling_table", with_(GAMES_SQL, "select game, home, away, home_score + away_score as total, home_score - away_score as margin from games"))
def modeling_table(spark: SparkSession, sf: str) -> DataFrame:
    """PL-04. Features and targets one to one; a violation would fail the query."""
    g = games(spark, sf)
    rows, gates = pipelines.modeling_table(g.select("game", "home", "away"), g.select("game", (F.col("home_score") + F.col("away_score")).alias("total"), (F.col("home_score") - F.col("away_score")).alias("margin")))
    quality.assert_clean(gates)
    return rows


@query("modeling_contract", with_(GAMES_SQL, "select game, season, home, away, home_score, away_score, home_score + away_score as target_total_points from games"))
def modeling_contract(spark: SparkSession, sf: str) -> DataFrame:
    """PL-04. Features and scores one to one, under the contract of columns and of each season's rows; a violation would fail the query."""
    g = games(spark, sf)
    counts = {r.season: r.n for r in g.groupBy("season").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a season
    names = ["game", "season", "home", "away", "home_score", "away_score", "target_total_points"]
    rows, gates = pipelines.modeling_table(g.select("game", "season", "home", "away"), g.select("game", "home_score", "away_score"), columns=names, width=7, expected=counts)
    quality.assert_clean(gates)
    return rows


@query("reconciled_log", with_(GAMES_SQL, """r as (select game as row_id, case when game % 5 = 0 then day + 1 else day end as day, home as team, case when game % 3 = 0 then 'e99' else away end as opponent from games),
    pg as (select day, least(home, away) || '|' || greatest(home, away) as pair, count(*) as n, min(game) as game from games group by 1, 2),
    m as (select r.*, case when n = 1 then pg.game end as found from r left join pg on pg.day = r.day and pg.pair = least(team, opponent) || '|' || greatest(team, opponent))
    select row_id, case when found is null then row_id else found end as game, found is null as exception from m"""))
def reconciled_log(spark: SparkSession, sf: str) -> DataFrame:
    """PL-10. A log against the schedule: exactly the rows that found no single game are overridden, or the query fails."""
    g = games(spark, sf)
    raw = g.selectExpr("game as row_id", "case when game % 5 = 0 then date_add(day, 1) else day end as day", "home as team", "case when game % 3 = 0 then 'e99' else away end as opponent", "concat('p', game) as player")
    matched = identity.matched_pairs(raw, g, ["day"], ("team", "opponent"), ("home", "away"), "game", "row_id")
    overrides = matched.where("match_status <> 'MATCHED'").select("row_id", F.col("row_id").alias("game"))
    final, why, gates = pipelines.reconciled(raw, g, overrides)
    quality.assert_clean(gates)
    return final.join(why.select("row_id", F.lit(True).alias("exception")), "row_id", "left").select("row_id", "game", F.coalesce("exception", F.lit(False)).alias("exception"))


@query("snapshot_audit", """with a as (select c_custkey as id, case c_custkey % 5 when 0 then 'Out' when 1 then null else case when c_custkey % 3 = 0 then 'Doubtful' end end as injury, case when c_custkey % 7 = 0 then null else 1 + c_custkey % 2 end as ord from customer where c_custkey % 10 <> 3),
    b as (select c_custkey as id, case when c_custkey % 2 = 0 then 'Out' end as injury from customer where c_custkey % 11 <> 5),
    s as (select case when injury = 'Out' then 'DEPTH_CHART_EXPECTED_OUT' when injury = 'Doubtful' then 'DEPTH_CHART_EXPECTED_DOUBTFUL' when ord is null then 'UNKNOWN' when ord = 1 then 'DEPTH_CHART_EXPECTED_HEALTHY' else 'BACKUP_CANDIDATE' end as v from a),
    t as (select s_suppkey % 400 as k, count(*) as n from supplier group by 1), w as (select case when t.n is null then 'UNMATCHED' when t.n = 1 then 'MATCHED' else 'CONFLICT' end as v from a left join t on t.k = a.id),
    c as (select case when b.id is null then 'first_seen' when a.id is null then 'dropped' when b.injury is null then 'populated' when a.injury is null then 'cleared' else 'changed' end as v from b full join a on a.id = b.id where a.id is null or b.id is null or a.injury is distinct from b.injury)
    select 'state' as what, v as value, count(*) as n from s group by 2 union all select 'status', v, count(*) from w group by 2 union all select 'change_type', v, count(*) from c group by 2""")
def snapshot_audit(spark: SparkSession, sf: str) -> DataFrame:
    """PL-11."""
    c = load(spark, sf, "customer")
    none = "cast(null as string)"
    after = c.where("c_custkey % 10 <> 3").selectExpr("c_custkey as id", "case c_custkey % 5 when 0 then 'Out' when 1 then null else case when c_custkey % 3 = 0 then 'Doubtful' end end as injury_status", f"{none} as practice_participation", f"{none} as roster_status", "case when c_custkey % 7 = 0 then null else cast(1 + c_custkey % 2 as int) end as depth_chart_order")
    before = c.where("c_custkey % 11 <> 5").selectExpr("c_custkey as id", "case when c_custkey % 2 = 0 then 'Out' end as injury_status")
    reference = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("target"), (F.col("s_suppkey") % 400).alias("ext"))
    return pipelines.snapshot_audit(before, after, reference, "id", ["injury_status"], [("ext", "id", "ext")], "target")["counts"]


@query("forensic_seasons", with_(QUOTES_SQL, _LEDGER_SQL, """select season, case when season is null then 'ALL' else 'season' end as grain, count(profit) as n, round(sum(profit), 4) as profit from ledger group by grouping sets ((season), ())"""))
def forensic_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """PL-08. A ledger's profit by season."""
    return pipelines.forensic_report(ledger(spark, sf))["by_season"].select("season", "grain", "n", F.round("profit", 4).alias("profit"))


@query("forensic_halves", with_(QUOTES_SQL, _LEDGER_SQL, """s as (select count(*) filter (season % 2 = 0 and profit > 0) as wa, count(*) filter (season % 2 = 0) as na, count(*) filter (season % 2 = 1 and profit > 0) as wb, count(*) filter (season % 2 = 1) as nb from ledger)
    select round((wa / na - wb / nb) / sqrt((wa + wb) / (na + nb) * (1 - (wa + wb) / (na + nb)) * (1.0 / na + 1.0 / nb)), 6) as z from s"""))
def forensic_halves(spark: SparkSession, sf: str) -> DataFrame:
    """PL-08, AG-32. Even and odd seasons compared."""
    return pipelines.forensic_report(ledger(spark, sf))["halves"].select(r6("z"))
