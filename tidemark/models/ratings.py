"""Pairwise ratings as a fold of a league's games.

A rating is not a window: each game changes both sides, nonlinearly. One key is one league under up to
eight sets of parameters. Its games are sorted by block and streamed, and only the ratings of its entities and the games of
the block at hand are held. Parallelism comes from leagues and sets of parameters; a single league's history is sequential.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.odds import Rating

class League:
    """The ratings of one league under one set of parameters, and the changes of the block at hand."""

    def __init__(self, config: Rating):
        self.c, self.ratings, self.season, self.block, self.changes = config, {}, None, None, {}

    def settle(self) -> None:
        """The changes of the block at hand count."""
        for entity, change in self.changes.items():
            self.ratings[entity] = self.ratings.get(entity, self.c.start) + change
        self.changes.clear()

    def begin(self, block: int, season: int) -> None:
        """Settles the block before; a new season carries every rating back to the start."""
        self.settle()
        if self.season is not None and season != self.season:
            self.ratings = {e: r + self.c.carry_back * (self.c.start - r) for e, r in self.ratings.items()}
        self.block, self.season = block, season

    def play(self, home: str, away: str, margin: float | None, neutral: bool, adjustment: float, post: bool) -> tuple[float, float, float, float | None, float]:
        """Ratings before, the probability of the home side, what came of it, and the change."""
        if home in self.changes or away in self.changes or home == away:
            raise ValueError(f"an entity plays twice in block {self.block}")
        c = self.c
        h, a = self.ratings.get(home, c.start), self.ratings.get(away, c.start)
        gap = h - a + (0.0 if neutral else c.home)
        expected = lambda x: 1 / (1 + 10 ** (-x / c.scale))
        p = min(c.highest, max(c.lowest, expected(gap + adjustment)))
        actual, change = None, 0.0
        if margin is not None:
            actual = 1.0 if margin > 0 else 0.5 if margin == 0 else 0.0
            # the change follows the ratings' own expectation, without adjustments
            change = (c.k_post if post else c.k) * min(c.margin_cap, 1 + (abs(margin) / c.margin_divisor) ** 2) * (actual - expected(gap))
        self.changes[home], self.changes[away] = change, -change
        return h, a, p, actual, change


#: Sets of parameters that one pass over a league's games folds.
SETS = 8
_PASS = "league string, block_ord int, season int, game string, home string, away string, actual double, config array<string>, before array<double>, other_before array<double>, p array<double>, change array<double>"


def _folded(configs: dict[str, Rating]):
    names = list(configs)
    parts = [names[k : k + SETS] for k in range(0, len(names), SETS)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leagues = None, {}
        for batch in batches:
            heads: list[tuple] = []
            sets, made = [], ([], [], [], [])
            for name, part, config, block, season, game, home, away, margin, neutral, adjustment, post in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, part) != at:
                    at, leagues = (name, part), {c: League(configs[c]) for c in parts[part]}
                if block is None:  # a rating to begin with
                    leagues[config].ratings[home], leagues[config].season = margin, season
                    continue
                y = None
                for league in leagues.values():
                    if block != league.block:
                        league.begin(block, season)
                    h, a, p, y, d = league.play(home, away, margin, neutral, adjustment, post)
                    for column, v in zip(made, (h, a, p, d), strict=True):
                        column.append(v)
                heads.append((name, block, season, game, home, away, y))
                sets.append(parts[part])
            columns = list(zip(*heads, strict=True)) if heads else [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3, pa.float64()]
            ends = [0]
            for s in sets:
                ends.append(ends[-1] + len(s))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.float64())) for c in made]
            arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(sets, pa.list_(pa.string())), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PASS.split(", ")])

    return rows


def rating_ledger(games: DataFrame, configs: dict[str, Rating], state: DataFrame | None = None) -> DataFrame:
    """ML-01, ML-02. Of games (league, block_ord, season, game, home, away, home_score, away_score, neutral, home_adjustment,
    away_adjustment, and post if there are post-season games) under each set of parameters: two rows a game with rating
    before, probability, change and rating after.

    Unplayed games are predicted and change nothing; what came of them is null. A block's games are all predicted before any
    counts. state: rating_state of the games before these, so that a history is continued and not folded again.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    swept = games.select(
        text("league"), F.explode(F.array(*(F.lit(k) for k in range(-(-len(configs) // SETS))))).alias("_part"), F.lit(None).cast("string").alias("config"), F.col("block_ord").cast("int").alias("block_ord"), F.col("season").cast("int").alias("season"), text("game"), text("home"), text("away"),
        (F.col("home_score") - F.col("away_score")).cast("double").alias("margin"), F.coalesce("neutral", F.lit(False)).alias("neutral"), (F.col("home_adjustment") - F.col("away_adjustment")).cast("double").alias("adjustment"),
        (F.coalesce("post", F.lit(False)) if "post" in games.columns else F.lit(False)).alias("post"),
    )
    if state is not None:
        part = F.create_map(*(F.lit(x) for k, name in enumerate(configs) for x in (name, k // SETS)))[F.col("config")]
        known = state.where(F.col("config").isin(*configs)).select("league", part.alias("_part"), "config", F.col("season").cast("int").alias("season"), F.col("entity").alias("home"), F.col("rating").alias("margin"))
        swept = swept.unionByName(known, allowMissingColumns=True)
    played = swept.repartition("league", "_part").sortWithinPartitions("league", "_part", "block_ord", "game").mapInArrow(_folded(configs), _PASS)
    each = played.select("league", "block_ord", "season", "game", "home", "away", "actual", F.explode(F.arrays_zip("config", "before", "other_before", "p", "change")).alias("_c"))
    side = lambda name, own, other, before, p, actual, change: F.struct(F.lit(name).alias("side"), F.col(own).alias("entity"), F.col(other).alias("other"), before.alias("before"), p.alias("p"), actual.alias("actual"), change.alias("change"), (before + change).alias("after"))
    c = lambda name: F.col(f"_c.{name}")
    home = side("home", "home", "away", c("before"), c("p"), F.col("actual"), c("change"))
    away = side("away", "away", "home", c("other_before"), 1 - c("p"), 1 - F.col("actual"), -c("change"))
    sides = each.select("league", c("config").alias("config"), "block_ord", "season", "game", F.explode(F.array(home, away)).alias("_s"))
    return sides.select("league", "config", "block_ord", "season", "game", "_s.*")


def rating_state(ledger: DataFrame, configs: dict[str, Rating]) -> DataFrame:
    """ML-03. league, config, entity, rating and season: the state that a ledger's games leave, as the fold itself holds it.

    An entity's rating is the one after its last game, carried back once for each season that its league has begun since.
    """
    played = ledger.groupBy("league", "config", "entity").agg(F.max_by(F.struct("after", "season"), F.struct("block_ord", "game")).alias("last"))
    # one row a league and season
    seasons = ledger.groupBy("league", "config", "season").agg(F.min("block_ord").alias("begun"))
    w = Window.partitionBy("league", "config").orderBy("begun")
    turns = seasons.select("league", "config", "season", F.row_number().over(w).alias("_k"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"), F.last("season").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_now"))
    share = F.create_map(*(F.lit(x) for name, c in configs.items() for x in (name, float(c.carry_back))))[F.col("config")]
    start = F.create_map(*(F.lit(x) for name, c in configs.items() for x in (name, float(c.start))))[F.col("config")]
    joined = played.select("league", "config", "entity", "last.after", "last.season").join(turns, ["league", "config", "season"])
    rating = start + (F.col("after") - start) * F.pow(1 - share, (F.col("_n") - F.col("_k")).cast("double"))
    return joined.select("league", "config", "entity", rating.alias("rating"), F.col("_now").alias("season"))


def replay_differences(ledger: DataFrame, games: DataFrame, configs: dict[str, Rating], tolerance: float = 1e-9) -> DataFrame:
    """ML-03. Rows of a stored ledger that a fresh fold of the games doesn't give again, and games that don't sum to zero."""
    key = ["league", "config", "game", "side"]
    again = rating_ledger(games, configs).select(*key, *(F.col(c).alias(f"_{c}") for c in ("before", "change", "after")))
    joined = ledger.join(again, key, "full")
    off = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) > tolerance, F.lit(True))
    wrong = joined.where(off("before") | off("change") | off("after")).select(*key, F.lit("DIFFERS").alias("problem"))
    sums = ledger.groupBy("league", "config", "game").agg(F.sum("change").alias("s")).where(F.abs("s") > tolerance)
    return wrong.unionByName(sums.select("league", "config", "game", F.lit("both").alias("side"), F.lit("NOT_ZERO_SUM").alias("problem")))
