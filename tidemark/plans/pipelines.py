"""Composite pipelines: the public entry points that chain operators into tables.

Each takes and returns lazy frames; gates come back beside the rows, to be run by quality.assert_clean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import functions as fn
from tidemark import quality
from tidemark.functions.text import strict_recode
from tidemark.models import fits
from tidemark.operators import asof, blocks, events, history, identity, offers, reshape, snapshots
from tidemark.operators import evaluation as ev
from tidemark.operators.scan import stored


@dataclass(frozen=True)
class Bundle:
    """PL-01. The frames of a feature bundle."""

    availability: DataFrame
    starters: DataFrame
    scenarios: DataFrame
    entity: DataFrame
    passers: DataFrame
    wide: DataFrame
    gates: DataFrame


def feature_bundle(games: DataFrame, facts: DataFrame, evidence: DataFrame, metrics: dict[str, float], passer_facts: DataFrame, passer_metrics: dict[str, float], sizes: tuple[int, ...] = (4, 8)) -> Bundle:
    """PL-01. Pregame features that see only facts available at the block's cutoff.

    games: game, season, block_ord, day, home, away; facts: entity, game, season, day and the metrics (name to prior);
    evidence: entity, candidate, rank, at; passer_facts: player, game and the passer metrics. A block's facts become
    usable at the boundary after its last day. Starters are resolved from the evidence before the cutoff; each of up to
    two candidates is a scenario with its own rolled passer features. wide has a row a game: both sides' entity
    features, the starter's state, the first scenario's candidate and its passer features.
    """
    weeks = fn.weekly_availability(games, ["block_ord"], "day")
    timed = games.join(weeks.select("block_ord", "as_of", "available_at"), "block_ord")
    sides = reshape.two_sided(timed, {"entity": "home"}, {"entity": "away"}, ["game", "season", "block_ord", "as_of"])
    available = timed.select("game", "available_at")

    def filled(names: dict[str, float]) -> list[Column]:
        return [c for m, prior in names.items() for k in sizes for c in history.with_prior(f"roll{k}_{m}_mean", prior, f"roll{k}_{m}_n", f"roll{k}_{m}")]

    # what a side sees hangs on its entity and block alone: it is picked once for each, and games look it up
    place = ["entity", "block_ord"]
    moments = stored(sides.select(*place, "as_of").distinct(), "moments")
    closed = asof.closing(facts.join(available, "game"), ["entity"], "season", "available_at", ["game"], list(metrics), list(sizes))
    values = [c for c in closed.columns if c.startswith(("roll", "std_"))]
    picked = asof.asof(moments, closed.withColumnRenamed("game", "_fact_game"), ["entity"], "as_of", "available_at", values, ["_fact_game"])
    features = stored(picked.select(*place, *filled(metrics), *(v for v in values if v.startswith("std_"))), "entity-features")
    entity = asof.found(sides.select("game", "season", "block_ord", "side", "entity"), features, place)
    led = stored(asof.resolved(moments, evidence, ["entity"], "candidate", "rank", "at", "as_of", "DEPTH_CHART_SUPPORTED"), "starters")
    starters = asof.found(sides, led.drop("as_of"), place)
    # candidates of a moment
    seen = reshape.scenarios(led, "candidates").withColumnRenamed("candidate", "player")
    players = seen.select("player").where("player is not null").distinct()
    own = asof.closing(passer_facts.join(players, "player", "leftsemi").join(available, "game"), ["player"], None, "available_at", ["game"], list(passer_metrics), list(sizes))
    own_values = [c for c in own.columns if c.startswith("roll")]
    asked = seen.select("player", "as_of").distinct()
    rolled = asof.asof(asked, own.withColumnRenamed("game", "_fact_game"), ["player"], "as_of", "available_at", own_values, ["_fact_game"])
    filled_in = asof.found(seen, rolled, ["player", "as_of"]).select(*place, "state", "scenario_rank", "player", *filled(passer_metrics))
    by_moment = stored(filled_in, "passer-features")
    scenarios = asof.found(sides, seen.withColumnRenamed("player", "candidate").drop("as_of"), place)
    passers = asof.found(sides.select("game", "side", *place), by_moment, place).drop(*place)
    first = by_moment.where("coalesce(scenario_rank, 1) = 1").select(*place, F.col("state").alias("starter_state"), F.col("player").alias("candidate"), *(F.col(c).alias(f"passer_{c}") for c in by_moment.columns if c.startswith("roll")))
    own_columns, first_columns = [c for c in features.columns if c not in place], [c for c in first.columns if c not in place]
    both = asof.found(features, first, place)
    wide = games.select("game", "season", "block_ord", "home", "away")
    for s in ("home", "away"):
        named = both.select(F.col("entity").alias(s), "block_ord", *(F.col(c).alias(f"{s}_{c}") for c in (*own_columns, *first_columns)))
        wide = asof.found(wide, named, [s, "block_ord"])
    sided = lambda names: [F.col(f"{s}_{c}") if c != "entity" else F.col(s).alias(f"{s}_entity") for s in ("home", "away") for c in names]
    wide = wide.select("game", "season", "block_ord", *sided(["entity", *own_columns]), *sided(first_columns))
    gates = quality.union(quality.unique_key(games, ["game"]), quality.unique_key(facts, ["entity", "game"]), quality.unique_key(passer_facts, ["player", "game"]), quality.once_per_block(games, ["block_ord"], ["home", "away"]))
    return Bundle(weeks, starters, scenarios, entity, passers, wide, gates)


def actual_entering(games: DataFrame, stats: DataFrame, starters: DataFrame, prior: float = -0.05, k: float = 250.0) -> tuple[DataFrame, DataFrame]:
    """PL-02. For each game and side the actual starter's shrunk efficiency from earlier blocks, and the gates.

    stats: player, block_ord, value (a rate), volume; starters: game, side, player. Sums by player run to the block before.
    """
    joined, gates = identity.guarded_join(reshape.two_sided(games, {"entity": "home"}, {"entity": "away"}, ["game", "block_ord"]), starters, ["game", "side"])
    weight = F.greatest("volume", F.lit(1))
    per = stats.where("value is not null").groupBy("player", "block_ord").agg(F.sum(F.col("value") * weight).alias("num"), F.sum(weight).cast("double").alias("den"), F.sum("volume").cast("long").alias("n"))
    facts = history.leaving_state(per, ["player"]).withColumn("usable", F.col("block_ord") + 1).drop("block_ord")
    picked = asof.asof(joined, facts, ["player"], "block_ord", "usable", ["num", "den", "n"])
    return picked.withColumn("shrunk_value", history.shrunk(F.col("num") / F.col("den"), F.coalesce("n", F.lit(0)), prior, k)).drop("num", "den"), gates


#: PL-03. The families of the totals table in order, with the least denominator of each. Fixed values.
FAMILIES = {
    "epa_per_play": 20,
    "success_rate": 20,
    "points_per_drive": 5,
    "scoring_drive_rate": 5,
    "seconds_per_play": 10,
    "neutral_seconds_per_play": 10,
    "neutral_pass_rate": 20,
    "red_zone_td_rate": 5,
    "goal_to_go_td_rate": 5,
    "turnovers_per_drive": 5,
    "sacks_per_dropback": 20,
    "air_yards_per_attempt": 20,
    "yac_per_completion": 20,
    "explosive_pass_rate": 20,
    "explosive_rush_rate": 20,
}
#: PL-03. A starter's columns in the totals table, in order. Fixed values.
PASSER = ["passing_epa", "passing_epa_imputed", "passing_cpoe", "passing_cpoe_imputed", "sacks_suffered_rate", "sack_rate_imputed", "interception_rate", "interception_rate_imputed", "recency_weighted_form", "low_sample", "missing_player_id"]
_BOTH = ("away", "home")
#: PL-03. The ninety columns: rest, roof, surface, both starters, and each family's matchups with their missing flags.
TOTALS_COLUMNS = [
    *(f"{s}_rest_days{m}" for s in _BOTH for m in ("", "_missing")),
    *(c for x in ("roof", "surface") for c in (f"{x}_category", f"{x}_missing")),
    *(f"{s}_qb_{c}" for s in _BOTH for c in PASSER),
    *(f"{s}_matchup_{f}{m}" for f in FAMILIES for s in _BOTH for m in ("", "_missing")),
]


def play_sums(plays: DataFrame, key: list[str]) -> DataFrame:
    """PL-03. key and the sums of each family's rate (events.sums), from the log of events.play_flags with game, drive, play_id, result.

    A drive counts if it has a valid play and a result, and its turnovers are summed. An interval counts between valid
    plays of one drive and quarter that are no kneels or spikes; it is neutral if it begins so. Drives and intervals are
    found beside the plays, along one sort of each game's plays, so the log is shuffled once, and not at all if it is dealt
    by game.
    """
    flagged = events.play_flags(plays).where("posteam is not null")
    number = lambda c: F.col(c).cast("double")
    stopped = (F.coalesce("qb_spike", F.lit(0)) != 0) | (F.coalesce("qb_kneel", F.lit(0)) != 0)
    flagged = flagged.withColumn("_clock", F.when(~stopped, F.col("game_seconds_remaining")))
    drive, order = ["game", "drive", "posteam"], ["play_id", "result"]
    gaps = events.intervals(flagged, drive, order, "_clock", ["qtr"], before=["is_neutral"], among=F.col("is_valid") & F.col("drive").isNotNull())
    rows = events.by_possession(gaps, drive, order, "result", {"any_valid": F.col("is_valid"), "any_red": F.col("in_red_zone"), "any_goal": F.col("is_goal_to_go")}, {"n_turnovers": F.col("is_turnover")})
    neutral = F.col("is_neutral") & (F.col("is_pass") | F.col("is_rush"))
    counted = F.col("first_of_possession") & F.col("any_valid") & F.col("result").isNotNull()
    # only of a drive that counts is the result looked up
    points = strict_recode(F.when(counted, F.col("result")), events.POSSESSION_POINTS)
    touchdown = (F.col("result") == "Touchdown").cast("double")
    return events.sums(rows, key, {
        "epa_per_play": events.Metric(F.col("has_epa"), F.col("epa")),
        "success_rate": events.Metric(F.col("has_success"), F.col("success")),
        "neutral_pass_rate": events.Metric(neutral, number("is_pass"), number("is_pass") + number("is_rush")),
        "sacks_per_dropback": events.Metric(F.col("is_dropback") & F.col("sack").isNotNull(), (F.col("sack") == 1).cast("double")),
        "air_yards_per_attempt": events.Metric(F.col("has_air_yards"), F.col("air_yards")),
        "yac_per_completion": events.Metric(F.col("has_yac"), F.col("yards_after_catch")),
        "explosive_pass_rate": events.Metric(F.col("is_pass") & F.col("has_yards"), number("is_explosive_pass")),
        "explosive_rush_rate": events.Metric(F.col("is_rush") & F.col("has_yards"), number("is_explosive_rush")),
        "points_per_drive": events.Metric(counted, points),
        "scoring_drive_rate": events.Metric(counted, F.col("result").isin(*events.SCORING).cast("double")),
        "turnovers_per_drive": events.Metric(counted, F.col("n_turnovers")),
        "red_zone_td_rate": events.Metric(counted & F.col("any_red"), touchdown),
        "goal_to_go_td_rate": events.Metric(counted & F.col("any_goal"), touchdown),
        "seconds_per_play": events.Metric(F.col("valid_interval"), F.col("seconds")),
        "neutral_seconds_per_play": events.Metric(F.col("valid_interval") & F.col("before_is_neutral"), F.col("seconds")),
    })


def totals_table(plays: DataFrame, games: DataFrame, context: DataFrame, passers: DataFrame, shown: Callable[[Column], Column] = lambda rate: rate) -> DataFrame:
    """PL-03. games (game, block_ord, home, away) with the ninety TOTALS_COLUMNS.

    plays: see play_sums; of a game only plays of blocks before it count. Plays that have block_ord, home and away, as their
    game has them, are not joined with games again. context: game, away_rest, home_rest, roof,
    surface, as the schedule has them. passers: game, side and PASSER, one row a side at most; flags may be boolean.
    shown: how a rate is given, such as rounded. Flags, sums, possessions and intervals are one pass over the plays; the rest
    works on entity-block sums, and rates are made once for each pair of entities and block, stored, and found by games.
    """
    pair = ["block_ord", "home", "away"]
    joined = plays if set(pair) <= set(plays.columns) else plays.join(games.select("game", *pair), "game")
    # what an entity made and allowed in a block is summed before it is unfolded by family
    names = [f"{f}_{c}" for f in FAMILIES for c in ("num", "den", "n")]
    per_pair = play_sums(joined, [*pair, "posteam"])
    other = F.when(F.col("posteam") == F.col("home"), F.col("away")).otherwise(F.col("home"))
    sides = F.explode(F.array(*(F.struct(e.alias("entity"), F.lit(s).alias("suffix")) for e, s in ((F.col("posteam"), ""), (other, "_allowed")))))
    per = per_pair.select(sides.alias("_s"), "block_ord", *names).groupBy("_s.entity", "_s.suffix", "block_ord").agg(*(F.sum(c).alias(c) for c in names))
    long = events.unfolded(per, ["entity", "suffix", "block_ord"], list(FAMILIES))
    states = history.leaving_state(long.withColumn("metric", F.concat("metric", "suffix")), ["entity", "metric"])
    rates = history.matchups(games.select(*pair).distinct(), states, {f: (f, f"{f}_allowed", float(least)) for f, least in FAMILIES.items()}, prefix="matchup_", missing=True)
    rates = stored(rates.select(*(c if c in pair or c.endswith("_missing") else shown(F.col(c)).alias(c) for c in rates.columns)), "matchups")
    category = lambda c: (F.coalesce(F.lower(c), F.lit("unknown")).alias(f"{c}_category"), F.col(c).isNull().cast("int").alias(f"{c}_missing"))
    rest = lambda s: (F.col(f"{s}_rest").cast("int").alias(f"{s}_rest_days"), F.col(f"{s}_rest").isNull().cast("int").alias(f"{s}_rest_days_missing"))
    known = context.select("game", *rest("away"), *rest("home"), *category("roof"), *category("surface"))
    kinds = dict(passers.dtypes)
    plain = passers.select("game", "side", *(F.col(c).cast("int").alias(f"qb_{c}") if kinds[c] == "boolean" else F.col(c).alias(f"qb_{c}") for c in PASSER))
    starters = reshape.wide_sides(plain, ["game"], "side", list(_BOTH), [f"qb_{c}" for c in PASSER])
    rows = asof.found(games.join(known, "game", "left").join(starters, "game", "left"), rates, pair)
    return rows.select(*games.columns, *TOTALS_COLUMNS)


#: What a modeling table must not hold: prices, lines and results. Fixed values.
SPORTSBOOK = ("spread_line", "total_line", "over_odds", "under_odds", "away_moneyline", "home_moneyline", "away_spread_odds", "home_spread_odds", "result", "total")


def modeling_table(features: DataFrame, targets: DataFrame, key: str = "game", columns: list[str] | None = None, width: int | None = None, season: str = "season", expected: dict[object, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """PL-04. Features and targets one to one by key, and the gates; targets that are scores get target_total_points, their sum.

    Gates: keys that repeat or are on one side alone, features that are columns of a sportsbook, games without a score, and
    if they are given the exact columns in their order, their number (100 for the totals contract), and the rows of
    each season.
    """
    rows, gates = identity.guarded_join(features, targets, [key], "modeling")
    found = [gates, quality.forbidden_columns(features, SPORTSBOOK)]
    if {"home_score", "away_score"} <= set(targets.columns):
        rows = rows.withColumn("target_total_points", F.col("home_score") + F.col("away_score"))
        found.append(quality.invariants(rows, {"a game without a score": F.col("target_total_points").isNotNull()}, "target"))
    wrong = []
    if columns is not None and rows.columns != columns:
        wrong.append(f"columns differ: {sorted(set(rows.columns) ^ set(columns)) or 'their order'}")
    if width is not None and len(rows.columns) != width:
        wrong.append(f"{len(rows.columns)} columns, expected {width}")
    found.append(rows.sparkSession.createDataFrame([("contract", w, 1) for w in wrong], quality.VIOLATION))
    if expected is not None:
        found.append(quality.expected_counts(rows, season, expected))
    return rows, quality.union(*found)


def canonical_quotes(long: DataFrame, targets: DataFrame, markets: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PL-05, SNK-06. Of long quotes (readers.unfolded): one row a game with presence and flags, one row a quote, and coverage by book.

    targets: game, day, home, away by the quotes' names. An event's game is found by day and unordered pair.
    """
    # read from their source once: events and quotes are both taken of these rows
    rows = stored(long.withColumn("day", F.to_date("starts_at")), "quotes")
    event = identity.matched_pairs(rows.select("event_id", "day", "home_team", "away_team", "snapshot_at", "starts_at").distinct(), targets, ["day"], ("home_team", "away_team"), ("home", "away"), "game", "event_id")
    quotes = rows.join(event.where("match_status = 'MATCHED'").select("event_id", "snapshot_at", "game"), ["event_id", "snapshot_at"])
    whole = quotes.where("valid")
    presence = offers.game_presence(whole, "game", "book", "market", markets)
    flags = offers.quality_flags(quotes.where("book is not null").groupBy("game", "book", "market", "snapshot_at").agg(F.bool_and("valid").alias("valid")), "game", "book", "market", F.col("valid"), markets)
    lead = event.where("match_status = 'MATCHED'").groupBy("game").agg(F.min(fn.minutes_between("snapshot_at", "starts_at")).alias("lead_minutes"), F.min("match_status").alias("match_status"))
    games = targets.join(lead, "game", "left").join(presence, "game", "left").join(flags, "game", "left").withColumn("match_status", F.coalesce("match_status", F.lit("UNMATCHED")))
    return games, quotes, offers.coverage(whole, "book", "market", "game", markets)


def edge_census(predictions: dict[str, DataFrame], quotes: DataFrame, book_order: list[str], anchor: str) -> DataFrame:
    """PL-06. For each model and moneyline side: its probability, the anchor book's no-vig probability, the best offer and the edge.

    predictions: model to (game, p_home). Models are stacked, not looped, so the quotes are shuffled once.
    """
    models = reshape.stacked([df.select("game", F.col("p_home"), F.lit(name).alias("model")) for name, df in predictions.items()])
    sides = models.select("game", "model", "p_home", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    ml = quotes.where("market = 'moneyline'")
    best = offers.best_offers(ml, ["game", "market", "side"], book_order).select("game", "side", F.col("book").alias("best_book"), F.col("price").alias("best_price"))
    pair = offers.max_price_offers(ml.where(F.col("book") == anchor), ["game", "side"], "price", ["book"])
    fair = reshape.wide_sides(pair, ["game"], "side", ["home", "away"], ["price"]).select("game", fn.no_vig("home_price", "away_price").alias("fair_home"))
    out = sides.join(best, ["game", "side"], "left").join(fair, "game", "left")
    p, fair_side = fn.oriented("side", "p_home"), fn.oriented("side", "fair_home")
    return out.select("game", "model", "side", p.alias("p"), fair_side.alias("p_market"), "best_book", "best_price", (p - fn.break_even("best_price")).alias("edge"), (p - fair_side).alias("disagreement"))


def census_families(models: DataFrame, points: DataFrame, quotes: DataFrame, anchor: str, backup: str, actionable: list[str]) -> DataFrame:
    """PL-06. The four families of the census, one under the other: TWO_SIDED, POSITIVE_EDGE, SPREAD and TOTAL.

    models: game, model, p_home. points: game, margin, total (what is expected). TWO_SIDED has each model and moneyline
    side: its probability, the edge in percentage points over the anchor's no-vig probability and over that of the mean
    of anchor and backup prices, and the value at the best price of the actionable books (the first of equals).
    POSITIVE_EDGE is the first side (home before away) whose edge is over zero. SPREAD and TOTAL have the side that the
    expected points favour against the anchor's line, by how many points, the best actionable offer of that side, and how
    many actionable prices are better than, equal to and worse than the anchor's. A book's best price counts.
    """
    best = offers.max_price_offers(quotes, ["game", "book", "market", "side"], "price", ["line"]).withColumn("dec", fn.american_to_decimal("price"))
    of = lambda book, c: F.max(F.when(F.col("book") == book, F.col(c)))
    rank = F.array_position(F.array(*map(F.lit, actionable)), F.col("book"))
    act = F.max(F.when(rank > 0, F.struct("dec", (-rank).alias("k"), "price", "book", "line")))
    sides = best.groupBy("game", "market", "side").agg(of(anchor, "dec").alias("anchor"), of(anchor, "line").alias("anchor_line"), of(backup, "dec").alias("backup"), act.alias("act"), *(of(b, "dec").alias(f"dec_{k}") for k, b in enumerate(actionable)))
    ml = sides.where("market = 'moneyline'")
    pair = reshape.wide_sides(ml, ["game"], "side", ["home", "away"], ["anchor", "backup"])
    fair = lambda h, a: (1 / h) / (1 / h + 1 / a)
    mean = lambda s: F.coalesce((F.col(f"{s}_anchor") + F.col(f"{s}_backup")) / 2, f"{s}_anchor", f"{s}_backup")
    market = pair.select("game", fair(F.col("home_anchor"), F.col("away_anchor")).alias("f"), fair(mean("home"), mean("away")).alias("r"))
    each = models.where("p_home is not null").select("game", "model", "p_home", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    offered = ml.select("game", "side", "act.price", "act.book", F.col("act.dec").alias("dec"))
    rows = each.join(market, "game", "left").join(offered, ["game", "side"], "left")
    p = fn.oriented("side", "p_home")
    # one difference, not one of two complements: those round twice more
    over = lambda c: F.when(F.col("side") == "home", F.col("p_home") - F.col(c)).otherwise(F.col(c) - F.col("p_home"))
    two = rows.select("game", "model", "side", p.alias("p"), (100 * over("f")).alias("edge"), (100 * over("r")).alias("edge_backup"), (p * F.col("dec") - 1).alias("value"), "price", "book")
    first = two.where("edge > 0").groupBy("game", "model").agg(F.max_by(F.struct("side", "p", "edge", "edge_backup", "value", "price", "book"), "side").alias("x")).select("game", "model", "x.*")

    def by_points(name: str, column: str, lead: str, other: str, gap: Column) -> DataFrame:
        line = sides.where((F.col("market") == name) & (F.col("side") == lead)).select("game", F.col("anchor_line").alias("_line")).where("_line is not null")
        found = points.where(F.col(column).isNotNull()).join(line, "game").withColumn("_gap", gap).where(F.abs("_gap") > 1e-9)
        chosen = found.select("game", F.when(F.col("_gap") > 0, lead).otherwise(other).alias("side"), F.abs("_gap").alias("points"))
        own = sides.where(F.col("market") == name)
        count = lambda test: reduce(lambda x, y: x + y, (F.coalesce(test(F.col(f"dec_{k}") - F.col("anchor")).cast("int"), F.lit(0)) for k in range(len(actionable))))
        counts = {"n_better": count(lambda d: d > 1e-9), "n_equal": count(lambda d: F.abs(d) <= 1e-9), "n_worse": count(lambda d: d < -1e-9)}
        return chosen.join(own, ["game", "side"], "left").select(F.lit(name.upper()).alias("family"), "game", "side", "points", F.col("act.price").alias("price"), F.col("act.book").alias("book"), F.col("act.line").alias("line"), "anchor_line", *(c.alias(k) for k, c in counts.items()))

    spread = by_points("spread", "margin", "home", "away", F.col("margin") + F.col("_line"))
    total = by_points("total", "total", "over", "under", F.col("total") - F.col("_line"))
    label = lambda df, name: df.select(F.lit(name).alias("family"), *df.columns)
    return reshape.stacked([label(two, "TWO_SIDED"), label(first, "POSITIVE_EDGE"), spread, total], widen=True)


#: What an offer is compared with the range of, in the rows that its state was fitted on.
SUPPORT = ("extremity", "gap", "constituent", "size")


def offer_board(quotes: DataFrame, models: DataFrame, book_order: list[str], least: int = 128, least_rows: int = 128, least_blocks: int = 4) -> DataFrame:
    """PL-09, ML-13. Every best offer of the three markets, evaluated by its own block's states, tiered and settled.

    quotes: game, block_ord, book, market, side, line, price, home_score, away_score (null before the result); models:
    game, p_home, margin, total, and p_home_a and p_home_b, the two chances that p_home is the mean of (equal to it if not
    given). Moneylines take pooling states (ML-09), and a tie the share of ties among earlier games; spreads and totals
    take point states of their market (ML-10): the market's implied mean, moved by beta to the model, and the chances of the
    offer's line among the residuals that the fit left. Support: a moneyline's distances of the calibrated market to a half
    and of the model to it, and of the model's two parts; a point offer's distance of the model to the market's mean, and
    the size of its line; each against its range in the rows of the fit. A tier counts the fewer of the fit's rows and
    of the reliability's (ML-14), and the distance of the parts, which points have none of. Everything is of earlier blocks.
    An offer without a state is UNSUPPORTED, passed and has a reason. Columns: game, market, side, book, line, price,
    block_ord, p_win, p_push, p_loss, value, distance, support, tier, status, settled and reason.
    """
    best = offers.best_offers(quotes, ["game", "market", "side"], book_order)
    first = F.col("side").isin("home", "over")
    other = best.select("game", "market", F.when(F.col("side") == "home", "away").when(F.col("side") == "away", "home").when(F.col("side") == "over", "under").otherwise("over").alias("side"), F.col("price").alias("_other"))
    parts = models.withColumns({c: F.col(c) if c in models.columns else F.col("p_home") for c in ("p_home_a", "p_home_b")})
    both = best.join(other, ["game", "market", "side"], "left").join(parts, "game")
    p_side = F.when(F.col("_other").isNotNull(), fn.no_vig("price", "_other")).otherwise(fn.break_even("price"))
    # everything about a game's first side: home or over
    margin = (F.col("home_score") - F.col("away_score")).cast("double")
    rows = both.withColumns({
        "first": first, "p_market": F.when(first, p_side).otherwise(1 - p_side), "actual": F.when(F.col("market") == "total", (F.col("home_score") + F.col("away_score")).cast("double")).otherwise(margin),
        "at": F.when(F.col("market") == "total", F.col("line")).when(first, -F.col("line")).otherwise(F.col("line")).cast("double"),
        "expected": F.when(F.col("market") == "total", F.col("total")).otherwise(F.col("margin")).cast("double"),
        "won": F.when(margin > 0, 1).when(margin < 0, 0), "constituent": F.when(F.col("market") == "moneyline", F.abs(F.col("p_home_a") - F.col("p_home_b"))),
    })
    rows = stored(rows, "offers")
    calendar = blocks.prior_nodes(rows.select("block_ord").distinct())
    ml = rows.where("market = 'moneyline'")
    pool = fits.pooling(ml.where("first"), calendar, "p_home", "p_market", "won", least)
    results = ml.where("first").groupBy("block_ord").agg(F.count("actual").alias("g"), F.count_if(F.col("actual") == 0).alias("t"))
    w = Window.orderBy("block_ord").rangeBetween(Window.unboundedPreceding, -1)
    ties = results.select("block_ord", F.coalesce(F.sum("g").over(w), F.lit(0)).alias("_games"), F.coalesce(F.sum("t").over(w), F.lit(0)).alias("_ties"))
    apart = ev.support(ml.select("block_ord", F.when(F.col("first") & F.col("won").isNotNull() & F.col("p_home").isNotNull() & F.col("p_market").isNotNull(), F.col("constituent")).alias("constituent")), ["constituent"], "block_ord")
    state = pool.select(F.col("target").alias("block_ord"), "intercept", "slope", "weight", "supported", "reason", F.col("n").alias("fit_n"), "extremity_low", "extremity_high", "gap_low", "gap_high")
    money = ml.join(state, "block_ord", "left").join(ties, "block_ord", "left").join(apart, "block_ord", "left")
    fair = F.when(F.col("supported"), fn.calibrated_probability("p_market", "intercept", "slope"))
    money = money.withColumn("_fair", fair).withColumn("_p", fn.pooled_probability("p_home", "_fair", "weight")).withColumn("_c", fn.with_ties(fn.oriented("side", "_p"), "_ties", "_games"))
    none = F.lit(None).cast("double")
    money = money.select(
        *rows.columns, F.col("_c.win").alias("p_win"), F.col("_c.push").alias("p_push"), F.col("_c.loss").alias("p_loss"), "fit_n", F.abs(F.col("_fair") - 0.5).alias("extremity"), F.abs(F.col("p_home") - F.col("_fair")).alias("gap"), none.alias("size"),
        *(f"{c}_{e}" for c in ("extremity", "gap", "constituent") for e in ("low", "high")), F.when(~F.coalesce("supported", F.lit(False)), F.coalesce("reason", F.lit("NO_STATE"))).alias("reason"),
    )

    def pointed(name: str) -> DataFrame:
        own = rows.where(F.col("market") == name)
        fitted, residuals = fits.point_states(own.where("first"), calendar, "expected", "at", "p_market", "actual", least)
        fitted = fitted.select(F.col("target").alias("block_ord"), "sigma", "beta", F.col("reason").alias("why"), F.col("n").alias("fit_n"), "gap_low", "gap_high", "size_low", "size_high")
        placed = fits.with_implied_mean(own.join(fitted, "block_ord", "left"), "at", "p_market", "sigma", "_market")
        placed = placed.withColumns({"gap": F.abs(F.col("expected") - F.col("_market")), "size": F.abs("line"), "extremity": none, "_fitted": F.col("why") == "FITTED"})
        placed = placed.withColumn("_mean", F.when(F.col("_fitted"), F.col("_market") + F.col("beta") * (F.col("expected") - F.col("_market"))))
        # each row of a fit leaves one residual
        placed = placed.withColumn("_left", F.when(F.col("_fitted"), F.col("fit_n")))
        priced = offers.lattice_probabilities(placed, residuals.withColumnRenamed("target", "block_ord"), ["block_ord"], "_mean", "_left")
        reason = F.when(F.col("why") != "FITTED", F.col("why")).when(F.col("why").isNull(), "NO_STATE").when(F.col("p_win").isNull(), "NO_LINE")
        return priced.select(*rows.columns, "p_win", "p_push", "p_loss", "fit_n", "extremity", "gap", "size", "gap_low", "gap_high", "size_low", "size_high", reason.alias("reason"))

    priced = reshape.stacked([money, pointed("spread"), pointed("total")], widen=True)
    given = F.col("p_win") / (F.col("p_win") + F.col("p_loss"))
    # written once: reliability and the board itself read it again
    priced = stored(priced.withColumn("settled", fn.settlement("market", "side", "line", "home_score", "away_score")), "priced")
    gaps = priced.where("first and p_win is not null and settled in ('WIN', 'LOSS')").select("market", "block_ord", (given - (F.col("settled") == "WIN").cast("double")).alias("gap"))
    every = priced.select("market", "block_ord").distinct().withColumn("gap", none)  # a state for each block, whatever it holds
    reliable = reshape.stacked([fits.reliability_states(gaps.unionByName(every).where(F.col("market") == m), least_rows=least_rows, least_blocks=least_blocks).withColumn("market", F.lit(m)) for m in offers.MARKETS])
    joined = priced.join(reliable.select("market", "block_ord", F.col("support").alias("_seen"), "radius", "stable"), ["market", "block_ord"], "left")
    has = F.col("p_win").isNotNull()
    joined = joined.withColumns({"distance": F.when(has, ev.support_distance(list(SUPPORT))), "support": F.when(has, F.least(F.col("fit_n"), F.coalesce("_seen", F.lit(0)))).otherwise(F.lit(0))})
    tier = F.when(has, fn.reliability_tier("support", "radius", "distance", F.coalesce("constituent", F.lit(0.0)), "stable")).otherwise("UNSUPPORTED")
    tiered = joined.withColumns({"tier": tier, "value": fn.three_way_value("p_win", "p_loss", "price")})
    play = fn.play_through(has, "value", given, fn.break_even("price"), "tier", "radius")
    return tiered.withColumn("_play", play).select("game", "market", "side", "book", "line", "price", "block_ord", "p_win", "p_push", "p_loss", "value", "distance", "support", "tier", F.when(has, F.col("_play.status")).otherwise("PASS").alias("status"), "settled", "reason")


def graded_ledger(census: DataFrame, results: DataFrame, least_edge: float, discovery_until: int) -> tuple[DataFrame, DataFrame]:
    """PL-07. Positive edges graded against results (game, season, home_score, away_score), and their summary by period, model and bucket.

    Seasons up to discovery_until are discovery, later ones confirmation; both are summed in one pass of grouping sets.
    """
    rows = census.where(F.col("edge") >= least_edge).join(results, "game")
    price = fn.american_to_decimal("best_price")
    g = fn.graded(F.lit("moneyline"), F.col("side"), F.lit(None).cast("double"), "home_score", "away_score", price)
    period = F.when(F.col("season") <= discovery_until, "discovery").otherwise("confirmation")
    bucket = fn.bucket("edge", [0.02, 0.05, 0.10], ["under 2", "2 to 5", "5 to 10", "10 and over"])
    ledger = rows.withColumns({"price_decimal": price, "profit": g["profit"], "period": period, "bucket": bucket})
    return ledger, offers.summaries(ledger, [["period", "model", "bucket"], ["period", "model"], ["period"], []], offers.summary(block="season"))


def forensic_report(ledger: DataFrame, group: str = "book", season: str = "season", order: tuple[str, ...] = ("game",)) -> dict[str, DataFrame]:
    """PL-08. Where a ledger's profit comes from: by season, price quantiles, concentration, running totals, halves compared."""
    p = F.col("profit")
    half = F.when(F.col(season) % 2 == 0, "a").otherwise("b")
    sums = ev.block_sums(ledger, season, {"p": p, "n": F.lit(1)})
    halves = ledger.agg(*(F.count_if((half == h) & (p > 0)).alias(f"w_{h}") for h in "ab"), *(F.count_if(half == h).alias(f"n_{h}") for h in "ab"))
    return {
        "by_season": offers.summaries(ledger, [[season], []], offers.summary()),
        "prices": ledger.groupBy(season).agg(F.percentile("price_decimal", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")),
        "concentration": offers.concentration(ledger, group, "profit"),
        "running": offers.running_profit(ledger, [season], list(order)),
        "interval": ev.bootstrap(sums, season, F.sum("p") / F.sum("n"), replicates=10_000),
        "half_difference": ev.bootstrap_difference(sums.withColumn("half", half), season, "half", ("a", "b"), F.sum("p") / F.sum("n"), replicates=10_000),
        "halves": halves.select(ev.two_proportions("w_a", "n_a", "w_b", "n_b").alias("t")).select("t.*"),
        "worst": ledger.orderBy("profit", *order).limit(20),
    }


def reconciled(raw: DataFrame, games: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PL-10. A starter log against the schedule: final rows, exceptions with their diagnosis, and the gates.

    raw: row_id, day, team, opponent, player; games: game, day, home, away; overrides: row_id, game. Exactly the rows
    that found no single game must be overridden.
    """
    matched = identity.matched_pairs(raw, games, ["day"], ("team", "opponent"), ("home", "away"), "game", "row_id")
    exception = F.col("match_status") != "MATCHED"
    sides = reshape.two_sided(games, {"team": "home", "opponent": "away"}, {"team": "away", "opponent": "home"}, ["game", "day"])
    why = identity.diagnosed(matched.where(exception).select(*raw.columns), sides, "day", "team", "opponent", "side", "game")
    final, gates = identity.overridden(matched, overrides, ["row_id"], "game", exception)
    return final, why, gates


def snapshot_audit(before: DataFrame, after: DataFrame, reference: DataFrame, key: str, fields: list[str], tiers: list[tuple[str, str, str]], target: str) -> dict[str, DataFrame]:
    """PL-11. A snapshot's evidence states, identities and changes, with counts of each."""
    states = after.withColumn("state", fn.evidence_state("injury_status", "practice_participation", "roster_status", "depth_chart_order"))
    walk = identity.crosswalk(after, reference, key, target, tiers)
    ledger = snapshots.changes(before, after, key, fields)
    n = lambda df, by: df.groupBy(F.lit(by).alias("what"), F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return {"states": states, "crosswalk": walk, "changes": ledger, "counts": reshape.stacked([n(states, "state"), n(walk, "status"), n(ledger, "change_type")])}


def scorecard(predictions: DataFrame, p: str, y: str, dims: list[str], tie: list[str]) -> dict[str, DataFrame]:
    """PL-12. Metrics at each dimension and overall, calibration, recalibration, ranking, worst rows and missingness."""
    return {
        "metrics": offers.summaries(predictions, [*([d] for d in dims), []], ev.scores(p, y)),
        "reliability": ev.reliability_table(predictions, p, y),
        "recalibration": fits.recalibration(predictions, p, y, dims[:1]),
        "auc": ev.auc(predictions, p, y),
        "worst": ev.worst(predictions, p, y, 20, tie),
        "missing": reshape.null_profile(predictions, [p, y]),
    }


def request_plan(games: DataFrame, zone: str = "America/New_York", span: int = 30, lead: int = 60) -> DataFrame:
    """PL-13. games (game, season, day, clock) clustered by kickoff in each day: one request `lead` minutes before each cluster's first."""
    timed = games.withColumn("kickoff", fn.local_to_utc("day", "clock", zone)).where("kickoff is not null")
    clusters = blocks.anchored_clusters(timed, ["season", "day"], "kickoff", span, "game")
    at = F.col("cluster_start") - F.make_dt_interval(mins=F.lit(lead))
    return clusters.select("season", "day", fn.joined_id("day", F.unix_micros("cluster_start")).alias("request"), at.alias("requested_at"), "cluster_start", "n", F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",").alias("games"))


def zone_rows(rows: DataFrame, p: str, price: str, p_range: tuple[float, float], price_range: tuple[float, float]) -> DataFrame:
    """PRJ-14, AG-40. The locked subset that a summary is taken of."""
    return rows.where(fn.in_zone(p, price, p_range, price_range))
