"""PL-08. Why a ledger's profit turned: thirteen views of its rows against games, prices and the models behind them.

candidates: game, season, week, side, p_model, edge (in points), price (American), book, win (1, 0, or null on a push), push,
profit. games: game, season, home, away, home_score, away_score, p_a and p_b (the home chances whose mean the model is),
home_price and away_price (of the reference book), fair_home (its chance without margin).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import functions as fn
from tidemark.operators import evaluation as ev
from tidemark.operators import offers, reshape
from tidemark.operators.scan import quantiles, stored

#: Bands of prices, chances and edges. Fixed values.
PRICE_BANDS = {"111-125": (111, 125), "126-150": (126, 150), "151-175": (151, 175), "176-200": (176, 200)}
CHANCE_BANDS = {"40-45": (0.40, 0.45), "45-50": (0.45, 0.50)}
EDGE_BANDS = {"0-5": (0, 5), "5-8": (5, 8), "8+": (8, 999)}


def _band(column: str, bands: dict[str, tuple[float, float]], closed: bool = False) -> Column:
    """The band that holds the column, null outside all; upper ends belong to it if closed."""
    out = F.lit(None).cast("string")
    for name, (low, high) in reversed(bands.items()):
        inside = (F.col(column) >= low) & ((F.col(column) <= high) if closed else (F.col(column) < high))
        out = F.when(inside, name).otherwise(out)
    return out


def record() -> list[Column]:
    """Rows, wins, losses, pushes, hit rate (pushes among the rows), profit and ROI."""
    n = F.count(F.lit(1))
    wins = F.count_if(F.col("win") == 1)
    return [n.alias("n"), wins.alias("wins"), F.count_if(F.col("win") == 0).alias("losses"), F.count_if(F.col("push")).alias("pushes"), (wins / n).alias("hit_rate"), F.sum("profit").alias("profit"), (F.sum("profit") / n).alias("roi")]


def _of_side(column: str) -> Column:
    """A home chance as the side's."""
    return F.when(F.col("side") == "away", 1 - F.col(column)).otherwise(F.col(column))


def _calibration(rows: DataFrame, by: list[str], models: dict[str, str], y: str) -> DataFrame:
    each = reshape.stacked([rows.select(*by, F.lit(m).alias("model"), F.col(c).cast("double").alias("_p"), F.col(y).cast("double").alias("_y")) for m, c in models.items()])
    known = each.where("_p is not null and _y is not null")
    p, seen = F.avg("_p"), F.avg("_y")
    return known.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("n"), seen.alias("observed"), p.alias("mean_p"), (100 * (p - seen)).alias("gap"), F.avg(F.pow(F.col("_p") - F.col("_y"), F.lit(2.0))).alias("brier"), F.avg(((F.col("_p") >= 0.5) == (F.col("_y") == 1)).cast("double")).alias("accuracy"),
    )


def concentration(rows: DataFrame, by: list[str], member: str = "team", worst: int = 5) -> DataFrame:
    """Of each group: rows, the sum of losing members' losses, the member of the largest profit or loss, that of the most rows,
    the worst losing members, and the shares of all losses of the worst and of the worst three."""
    per = rows.groupBy(*by, member).agg(F.count(F.lit(1)).alias("_n"), F.sum("profit").alias("_s"))
    order = Window.partitionBy(*by).orderBy("_s", member)
    lost = F.when(F.col("_s") < 0, F.row_number().over(order))  # members are few; one row each
    per = per.withColumn("_k", lost)
    one = lambda k: F.max(F.when(F.col("_k") == k, F.col(member)))
    losses = F.sum(F.when(F.col("_s") < 0, -F.col("_s")).otherwise(0.0))
    top = lambda k: F.sum(F.when(F.col("_k") <= k, -F.col("_s")).otherwise(0.0)) / F.nullif(losses, F.lit(0.0))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("n"), losses.alias("total_loss"), F.max_by(member, F.struct(F.abs("_s"), F.col(member))).alias("largest"), F.max_by("_s", F.struct(F.abs("_s"), F.col(member))).alias("largest_profit"), F.max_by(member, F.struct("_n", F.col(member))).alias("most_rows"),
        F.array_compact(F.array(*(one(k) for k in range(1, worst + 1)))).alias("worst"), top(1).alias("worst_share"), top(3).alias("worst_three_share"),
    )


class Views(Mapping):
    """Frames by name, each made when it is asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers = makers

    def __getitem__(self, name: str) -> DataFrame:
        return self.makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def forensics(candidates: DataFrame, games: DataFrame, discovery_until: int, replicates: int = 10_000, seed: int = 42) -> Views:
    """PL-08. The views by name; seasons up to discovery_until are discovery, later ones confirmation. The joined rows are written once.

    sides, identity, recomputed, calibration, chance_bands, interaction, book_mix, price_bands, distributions, teams,
    chronology, disagreement, orientation, global_calibration, proportions, and block_hit_rate and block_roi, the
    bootstrap intervals of discovery minus confirmation over blocks of season and week.
    """
    rows = candidates.join(games.drop("season"), "game", "left").withColumns({
        "period": F.when(F.col("season") <= discovery_until, "DISCOVERY").otherwise("CONFIRMATION"), "team": F.when(F.col("side") == "home", F.col("home")).otherwise(F.col("away")),
        "p_a_side": _of_side("p_a"), "p_b_side": _of_side("p_b"), "fair": _of_side("fair_home"), "price_side": F.when(F.col("side") == "home", F.col("home_price")).otherwise(F.col("away_price")), "price_other": F.when(F.col("side") == "home", F.col("away_price")).otherwise(F.col("home_price")),
        "chance_band": _band("p_model", CHANCE_BANDS), "edge_band": _band("edge", EDGE_BANDS), "price_band": _band("price", PRICE_BANDS, closed=True),
    })
    rows = stored(rows, "forensic-rows")
    flags = {
        "plus_money": F.col("price") > 100, "underdog_by_fair": F.col("fair") < 0.5, "underdog_by_price": F.col("price_side") > 100,
        "favorite_by_fair": F.col("fair") >= 0.5, "price_is_the_others": F.abs(F.col("price") - F.col("price_other")) <= 1,
    }
    again = fn.graded(F.lit("moneyline"), F.col("side"), F.lit(None).cast("double"), "home_score", "away_score", fn.american_to_decimal("price"))
    recomputed = rows.where("home_score is not null and away_score is not null").withColumn("_g", again)
    new_win = F.when(~F.col("_g.push"), F.col("_g.win").cast("int"))
    recomputed = recomputed.select("game", "season", "side", "price", "home_score", "away_score", "win", new_win.alias("win_again"), "profit", F.col("_g.profit").alias("profit_again"), (F.col("win").eqNullSafe(new_win) & (F.col("push") == F.col("_g.push")) & (F.abs(F.col("profit") - F.col("_g.profit")) < 1e-6)).alias("matches"))
    average = F.when(F.col("p_a_side").isNotNull() & F.col("p_b_side").isNotNull(), (F.col("p_a_side") + F.col("p_b_side")) / 2).otherwise(F.coalesce("p_a_side", "p_b_side"))
    both = rows.where("p_a_side is not null and p_b_side is not null").withColumn("_d", F.abs(F.col("p_a_side") - F.col("p_b_side")))
    spread = [F.count(F.lit(1)).alias("n"), (100 * F.avg("_d")).alias("mean_spread"), (100 * F.stddev_samp("_d")).alias("std_spread"), F.count_if(F.col("p_a_side") > F.col("p_b_side")).alias("n_a_higher"), F.count_if(F.col("p_a_side") <= F.col("p_b_side")).alias("n_b_higher")]
    scope = F.explode(F.array(F.lit("ALL"), F.col("period"), F.concat(F.lit("season_"), F.col("season").cast("string"))))
    priced = rows.where("fair is not null").select(F.explode(F.array(F.lit("ALL"), F.col("season").cast("string"))).alias("scope"), "fair", (100 * (F.col("p_model") - F.col("fair"))).alias("over"))
    quarters = {f"q{k}": k / 4 for k in (1, 2, 3)}

    def distributions() -> DataFrame:
        out = priced.groupBy("scope").agg(F.avg("fair").alias("mean_fair"), F.avg("over").alias("mean_edge"))
        for name in ("fair", "over"):
            out = out.join(quantiles(priced, name, {f"{name}_{k}": v for k, v in quarters.items()}, ["scope"]).drop("n"), "scope", "left")
        return out

    result = games.withColumns({"home_win": F.when(F.col("home_score") != F.col("away_score"), (F.col("home_score") > F.col("away_score")).cast("double")), "p_mean": (F.col("p_a") + F.col("p_b")) / 2})
    whole = _calibration(result, ["season"], {"a": "p_a", "b": "p_b", "mean": "p_mean"}, "home_win")
    own = _calibration(rows, ["season"], {"mean": "p_model", "a": "p_a_side", "b": "p_b_side"}, "win")
    slice_gap = own.where("model = 'mean'").select("season", F.col("gap").alias("slice_gap"))
    of = lambda p: F.col("period") == p
    totals = rows.agg(*(x for p in ("DISCOVERY", "CONFIRMATION") for x in (F.count_if(of(p) & (F.col("win") == 1)).alias(f"w_{p}"), F.count_if(of(p)).alias(f"n_{p}"))))
    sums = rows.groupBy("period", F.concat_ws("-", F.lpad(F.col("season").cast("string"), 6, "0"), F.lpad(F.col("week").cast("string"), 6, "0")).alias("block")).agg(F.sum("profit").alias("p"), F.count_if(F.col("win") == 1).alias("w"), F.count(F.lit(1)).alias("n"))
    apart = lambda stat: ev.bootstrap_difference(sums, "block", "period", ("CONFIRMATION", "DISCOVERY"), stat, replicates, seed)
    return Views({
        "sides": lambda: offers.summaries(rows, [["season", "side"], ["side"]], record()),
        "identity": lambda: rows.select("game", "season", "side", "p_model", "price", "fair", "price_side", "price_other", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items())),
        "recomputed": lambda: recomputed,
        "calibration": lambda: own,
        "chance_bands": lambda: rows.where("chance_band is not null").groupBy("season", "chance_band").agg(*record()),
        "interaction": lambda: offers.summaries(rows.where("chance_band is not null or edge_band is not null"), [["season", "side", "chance_band"], ["season", "side", "edge_band"]], record()).where("chance_band is not null or edge_band is not null"),
        "book_mix": lambda: offers.summaries(rows, [["season", "book"], ["book"]], record()),
        "price_bands": lambda: offers.summaries(rows.where("price_band is not null"), [["season", "price_band"], ["price_band"]], record()),
        "distributions": distributions,
        "teams": lambda: concentration(rows.withColumn("scope", scope), ["scope"]),
        "chronology": lambda: offers.running_profit(rows.where("week is not null"), ["season"], ["week", "game", "side"], sliced=True).select("season", "week", "game", "side", "bet_no", "cum_wins", "cum_profit", "cum_roi"),
        "disagreement": lambda: offers.summaries(both, [["season"], []], spread),
        "orientation": lambda: rows.select("game", "season", "side", "p_model", average.alias("p_from_sides"), F.coalesce(F.abs(average - F.col("p_model")) < 1e-9, F.lit(False)).alias("matches")),
        "global_calibration": lambda: whole.join(slice_gap, "season", "left"),
        "proportions": lambda: totals.select(ev.two_proportions("w_DISCOVERY", "n_DISCOVERY", "w_CONFIRMATION", "n_CONFIRMATION").alias("t")).select("t.*"),
        "block_hit_rate": lambda: apart(F.sum("w") / F.sum("n")),
        "block_roi": lambda: apart(F.sum("p") / F.sum("n")),
    })
