"""The given tables, and the games, quotes, predictions and plays that the queries derive from them.

Each derived frame has its DuckDB text beside it, for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with DuckDB SQL for the same rows if there is any."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, f"{sf_dir}/{name}.parquet")


#: Orders as games between 25 entities: a season a year, a block a month.
GAMES_SQL = """games as (
    select o_orderkey as game, year(o_orderdate) as season, month(o_orderdate) as month, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) as block_ord,
           cast(o_orderdate as date) as day, 'e' || (o_custkey % 25) as home, 'e' || ((o_custkey % 25 + 1 + o_orderkey % 24) % 25) as away,
           cast(floor(o_totalprice) as bigint) % 41 as home_score, cast(floor(o_totalprice / 7) as bigint) % 38 as away_score,
           o_orderkey % 10 = 0 as neutral, o_orderpriority as priority
    from orders)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as game", "year(o_orderdate) as season", "month(o_orderdate) as month", "(year(o_orderdate) - 1990) * 12 + month(o_orderdate) as block_ord",
        "cast(o_orderdate as date) as day", "concat('e', o_custkey % 25) as home", "concat('e', (o_custkey % 25 + 1 + o_orderkey % 24) % 25) as away",
        "cast(floor(o_totalprice) as bigint) % 41 as home_score", "cast(floor(o_totalprice / 7) as bigint) % 38 as away_score",
        "o_orderkey % 10 = 0 as neutral", "o_orderpriority as priority",
    )


#: Line items as quotes: a part is a game, suppliers fold to six books, prices are American.
QUOTES_SQL = """raw_quotes as (
    select l_orderkey, l_linenumber, l_partkey as game, 'b' || (l_suppkey % 6) as book, case l_linenumber % 3 when 0 then 'moneyline' when 1 then 'spread' else 'total' end as market,
           l_orderkey % 2 as parity, cast(round(l_discount * 100) as bigint) as disc, cast(floor(l_extendedprice) as bigint) % 301 - 150 as x, year(l_shipdate) as season, month(l_shipdate) as month
    from lineitem),
quotes as (
    select l_orderkey, l_linenumber, game, book, market, case when market = 'total' then case parity when 0 then 'over' else 'under' end else case parity when 0 then 'home' else 'away' end end as side,
           case market when 'spread' then (disc - 5) / 2.0 * case parity when 0 then 1 else -1 end when 'total' then 25 + disc / 2.0 end as line,
           case when x >= 0 then 100 + x else x - 100 end as price, game % 31 as home_score, (game * 7) % 29 as away_score, season, month
    from raw_quotes)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey as game", "concat('b', l_suppkey % 6) as book", "case l_linenumber % 3 when 0 then 'moneyline' when 1 then 'spread' else 'total' end as market",
        "l_orderkey % 2 as parity", "cast(round(l_discount * 100) as bigint) as disc", "cast(floor(l_extendedprice) as bigint) % 301 - 150 as x", "year(l_shipdate) as season", "month(l_shipdate) as month",
    )
    return raw.selectExpr(
        "l_orderkey", "l_linenumber", "game", "book", "market", "case when market = 'total' then case parity when 0 then 'over' else 'under' end else case parity when 0 then 'home' else 'away' end end as side",
        "cast(case market when 'spread' then (disc - 5) / 2.0D * case parity when 0 then 1 else -1 end when 'total' then 25 + disc / 2.0D end as double) as line",
        "case when x >= 0 then 100 + x else x - 100 end as price", "game % 31 as home_score", "(game * 7) % 29 as away_score", "season", "month",
    )


#: A prediction for each labelled document: p from its length, a second one from its id.
PREDICTIONS_SQL = """predictions as (
    select l.doc_id, quality as y, toxic = 1 as tie, lang, source, l.doc_id % 12 as week, l.doc_id % 4 as season, (n_chars % 997) / 997.0 as p, (l.doc_id * 37 % 101) / 101.0 as p2
    from labels l join documents d on l.doc_id = d.doc_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id").selectExpr("doc_id", "quality as y", "toxic = 1 as tie", "lang", "source", "doc_id % 12 as week", "doc_id % 4 as season", "(n_chars % 997) / 997.0D as p", "(doc_id * 37 % 101) / 101.0D as p2")


#: Line items as a play log: an order is a game, its returned items end a possession.
PLAYS_SQL = """plays as (
    select l_orderkey as game, (l_linenumber * 10000000 + l_partkey) * 1000 + l_suppkey % 1000 as play_id, (l_linenumber - 1) // 3 as drive, case when l_suppkey % 11 = 0 then null else 's' || (l_suppkey % 7) end as posteam,
           case when l_suppkey % 11 <> 0 and l_suppkey % 53 <> 1 then 's' || ((l_suppkey + 1) % 7) end as defteam, case when l_partkey % 13 = 0 then 'qb_kneel' when l_partkey % 17 = 0 then 'qb_spike' when l_partkey % 3 = 0 then 'pass' when l_partkey % 37 = 0 then 'punt' else 'run' end as play_type,
           case when l_partkey % 3 = 0 and l_partkey % 10 <> 3 then cast(l_partkey % 40 - 5 as double) end as air_yards, case when l_partkey % 10 <> 6 then cast(l_partkey % 12 as double) end as yards_after_catch,
           case when l_quantity > 48 then 1.0 else 0.0 end as play_deleted, 0.0 as aborted_play, case when l_partkey % 3 = 0 then 1.0 else 0.0 end as pass_attempt,
           case when l_partkey % 3 = 1 then 1.0 else 0.0 end as rush_attempt, case when l_partkey % 6 = 0 then 1.0 else 0.0 end as complete_pass,
           case l_partkey % 5 when 0 then null when 1 then 1.0 else 0.0 end as qb_dropback, case when l_partkey % 13 = 0 then 1.0 else 0.0 end as qb_kneel,
           case when l_partkey % 17 = 0 then 1.0 else 0.0 end as qb_spike, case when l_partkey % 19 = 0 then 1.0 else 0.0 end as sack,
           case when l_suppkey % 9 = 0 then null else l_discount * 10 - 0.5 end as epa, case when l_suppkey % 9 = 0 then null else l_partkey % 2 * 1.0 end as success,
           case when l_partkey % 23 = 0 then 1.0 else 0.0 end as interception, case when l_partkey % 29 = 0 then 1.0 else 0.0 end as fumble_lost,
           l_linenumber % 4 + 1 as qtr, cast(l_quantity as bigint) % 20 - 10 as score_differential, case when l_suppkey % 8 = 0 then null else 3600 - 200 * l_linenumber - l_partkey % 300 end as game_seconds_remaining,
           l_partkey % 100 as yardline_100, case when l_partkey % 31 = 0 then 1.0 else 0.0 end as goal_to_go, cast(l_quantity as bigint) - 20 as yards_gained,
           case l_returnflag when 'R' then 'Touchdown' when 'A' then 'Field goal' end as result
    from lineitem)"""


def plays(spark: SparkSession, sf_dir: str, by_game: bool = False) -> DataFrame:
    """by_game: the lines are dealt by game before they widen to plays, to a number of parts that stays as it is, as narrow rows would be gathered to few."""
    flag = lambda c: f"case when {c} then 1.0D else 0.0D end"
    lines = load(spark, sf_dir, "lineitem")
    return (lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey") if by_game else lines).selectExpr(
        "l_orderkey as game", "(l_linenumber * 10000000 + l_partkey) * 1000 + l_suppkey % 1000 as play_id", "(l_linenumber - 1) div 3 as drive", "case when l_suppkey % 11 = 0 then null else concat('s', l_suppkey % 7) end as posteam",
        "case when l_suppkey % 11 <> 0 and l_suppkey % 53 <> 1 then concat('s', (l_suppkey + 1) % 7) end as defteam", "case when l_partkey % 13 = 0 then 'qb_kneel' when l_partkey % 17 = 0 then 'qb_spike' when l_partkey % 3 = 0 then 'pass' when l_partkey % 37 = 0 then 'punt' else 'run' end as play_type",
        "case when l_partkey % 3 = 0 and l_partkey % 10 <> 3 then cast(l_partkey % 40 - 5 as double) end as air_yards", "case when l_partkey % 10 <> 6 then cast(l_partkey % 12 as double) end as yards_after_catch",
        f"{flag('l_quantity > 48')} as play_deleted", "0.0D as aborted_play", f"{flag('l_partkey % 3 = 0')} as pass_attempt", f"{flag('l_partkey % 3 = 1')} as rush_attempt", f"{flag('l_partkey % 6 = 0')} as complete_pass",
        "case l_partkey % 5 when 0 then null when 1 then 1.0D else 0.0D end as qb_dropback", f"{flag('l_partkey % 13 = 0')} as qb_kneel", f"{flag('l_partkey % 17 = 0')} as qb_spike", f"{flag('l_partkey % 19 = 0')} as sack",
        "case when l_suppkey % 9 = 0 then null else l_discount * 10 - 0.5D end as epa", "case when l_suppkey % 9 = 0 then null else l_partkey % 2 * 1.0D end as success", f"{flag('l_partkey % 23 = 0')} as interception", f"{flag('l_partkey % 29 = 0')} as fumble_lost",
        "l_linenumber % 4 + 1 as qtr", "cast(l_quantity as bigint) % 20 - 10 as score_differential", "case when l_suppkey % 8 = 0 then null else 3600 - 200 * l_linenumber - l_partkey % 300 end as game_seconds_remaining",
        "l_partkey % 100 as yardline_100", f"{flag('l_partkey % 31 = 0')} as goal_to_go", "cast(l_quantity as bigint) - 20 as yards_gained", "case l_returnflag when 'R' then 'Touchdown' when 'A' then 'Field goal' end as result",
    )


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts)
