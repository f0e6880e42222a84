"""Prices, probabilities, ratings, grading and value: arithmetic on columns, all inside code generation.

A null operand gives null unless said otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import as_column as _c

Num = Column | str | float | int


def clip(x: Num, low: float = 0.01, high: float = 0.99) -> Column:
    """FN-05. The value, held inside [low, high]."""
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(x).cast("double"))))


def american_to_decimal(price: Num) -> Column:
    """FN-01. +150 is 2.5, -200 is 1.5; a price of zero is null."""
    p = _c(price).cast("double")
    return F.when(p > 0, 1 + p / 100).when(p < 0, 1 - 100 / p)


def decimal_to_american(price: Num) -> Column:
    """FN-02. Rounded half to even; null at or under 1."""
    d = _c(price).cast("double")
    return F.bround(_american(d)).cast("int")


def conservative_american(price: Num) -> Column:
    """FN-02. The next American price that is no worse for the bettor."""
    return F.ceil(_american(_c(price).cast("double")) - 1e-12).cast("int")


def _american(d: Column) -> Column:
    return F.when(d >= 2, (d - 1) * 100).when(d > 1, -100 / (d - 1))


def break_even(price: Num) -> Column:
    """FN-03. Of an American price."""
    return 1 / american_to_decimal(price)


def break_even_decimal(price: Num) -> Column:
    """FN-03. Of a decimal price; null if the price isn't positive."""
    return F.when(_c(price) > 0, 1 / _c(price).cast("double"))


def no_vig(price_a: Num, price_b: Num) -> Column:
    """FN-04. The share of side a in the two sides' break-even probabilities."""
    a, b = break_even(price_a), break_even(price_b)
    return a / (a + b)


def logit(p: Num) -> Column:
    """FN-05. Of the clipped probability."""
    q = clip(p)
    return F.log(q / (1 - q))


def sigmoid(x: Num) -> Column:
    """FN-05. Stable at both ends."""
    z = F.exp(-F.abs(_c(x)))
    return F.when(_c(x) >= 0, 1 / (1 + z)).otherwise(z / (1 + z))


def calibrated_probability(raw: Num, intercept: Num, slope: Num) -> Column:
    """FN-06."""
    return sigmoid(_c(intercept) + _c(slope) * logit(raw))


def pooled_probability(model: Num, market: Num, weight: Num) -> Column:
    """FN-06. Between market (weight 0) and model (weight 1), in logits."""
    return sigmoid(logit(market) + _c(weight) * (logit(model) - logit(market)))


#: Coefficients of the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7). Fixed values.
ERF = {"p": 0.3275911, "a": (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)}
#: Coefficients of Acklam's inverse normal approximation (relative error below 1.2e-9). Fixed values.
ACKLAM = {
    "a": (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    "b": (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01),
    "c": (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    "d": (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00),
    "low": 0.02425,
}


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Num) -> Column:
    """FN-07. By the approximation of erf above."""
    x = F.abs(_c(z).cast("double")) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF["p"] * x)
    tail = 0.5 * t * _poly(t, ERF["a"][::-1]) * F.exp(-x * x)
    return F.when(_c(z) >= 0, 1 - tail).otherwise(tail)


def normal_inverse(p: Num) -> Column:
    """FN-07. By Acklam's approximation; null outside (0, 1)."""
    q = _c(p).cast("double")
    low = ACKLAM["low"]
    ends = lambda x: _poly(x, ACKLAM["c"]) / (_poly(x, ACKLAM["d"]) * x + 1)
    mid = q - 0.5
    r = mid * mid
    centre = _poly(r, ACKLAM["a"]) * mid / (_poly(r, ACKLAM["b"]) * r + 1)
    lower, upper = ends(F.sqrt(-2 * F.log(q))), -ends(F.sqrt(-2 * F.log(1 - q)))
    return F.when((q > 0) & (q < low), lower).when((q >= low) & (q <= 1 - low), centre).when((q > 1 - low) & (q < 1), upper)


def allows_push(line: Num) -> Column:
    """FN-08. Whether a result can equal the line."""
    return F.abs(_c(line) - F.bround(_c(line).cast("double"))) <= 1e-9


def above_probability(mean: Num, line: Num, sigma: Num) -> Column:
    """FN-08. P(above the line, given no push) of a normal score; an integer line gives up the cell of half a point to either side."""
    z = lambda t: normal_cdf((t - _c(mean)) / _c(sigma))
    loss, win = z(_c(line) - 0.5), 1 - z(_c(line) + 0.5)
    return F.when(allows_push(line), win / (win + loss)).otherwise(1 - z(_c(line)))


def implied_mean(line: Num, p_above: Num, sigma: Num) -> Column:
    """FN-09. The mean at which P(above) is p, for lines that no result equals; null for others (see models.implied_means)."""
    return F.when(~allows_push(line), _c(line) + _c(sigma) * normal_inverse(clip(p_above)))


@dataclass(frozen=True)
class Rating:
    """FN-10, FN-11, FN-35. Parameters of a pairwise rating."""

    start: float = 1500.0
    k: float = 20.0
    k_post: float = 4.0
    home: float = 48.0
    scale: float = 400.0
    margin_divisor: float = 6.0
    margin_cap: float = 2.5
    carry_back: float = 1 / 3
    lowest: float = 0.01
    highest: float = 0.99


def expected_score(rating: Num, other: Num, scale: float = 400.0) -> Column:
    """FN-10."""
    return 1 / (1 + F.pow(F.lit(10.0), (_c(other) - _c(rating)) / scale))


def home_probability(home: Num, away: Num, home_bonus: Num = 0.0, home_adjustment: Num = 0.0, away_adjustment: Num = 0.0) -> Column:
    """FN-10."""
    return expected_score(_c(home) + _c(home_bonus) + _c(home_adjustment), _c(away) + _c(away_adjustment))


def margin_multiplier(margin: Num, divisor: float = 6.0, cap: float = 2.5) -> Column:
    """FN-11. One for a tie, growing with the square of the margin up to a cap."""
    return F.least(F.lit(float(cap)), 1 + F.pow(F.abs(_c(margin)) / divisor, F.lit(2.0)))


def entity_adjustment(candidate: Num, certainty: Num, value: Num, replacement: float = 0.0, scale: float = 100.0, most: float = 60.0) -> Column:
    """FN-12. Rating points of a confirmed candidate over a replacement, clipped; zero in any other state."""
    confirmed = F.coalesce((_c(certainty) == "CONFIRMED_PRE_CUTOFF") & _c(candidate).isNotNull() & _c(value).isNotNull(), F.lit(False))
    return F.when(confirmed, clip((_c(value) - replacement) * scale, -most, most)).otherwise(F.lit(0.0))


def adjustment_state(candidate: Num, certainty: Num, value: Num) -> Column:
    """FN-12. The label that goes with entity_adjustment."""
    supported = F.coalesce(_c(certainty).isin("DEPTH_CHART_SUPPORTED", "ROSTER_SUPPORTED", "AMBIGUOUS"), F.lit(False))
    known = _c(candidate).isNotNull()
    return (
        F.when(known & (_c(certainty) == "CONFIRMED_PRE_CUTOFF"), F.when(_c(value).isNull(), "CONFIRMED_BUT_NO_DATA").otherwise("CONFIRMED"))
        .when(known & supported, "SUPPORTED_BUT_UNCERTAIN")
        .otherwise("UNKNOWN")
    )


def carried_rating(rating: Num, fraction: float = 1 / 3, centre: float = 1500.0) -> Column:
    """FN-35. A rating drawn back toward the centre at the turn of a season."""
    return _c(rating) + fraction * (centre - _c(rating))


def signed_edge(market: Num, side: Num, line: Num, home: Num, away: Num) -> Column:
    """FN-13, FN-14. By how much a bet is won (over 0), pushed (0) or lost: the margin of the side plus its line, or the total's distance to the line.

    market: moneyline, spread or total; side: home, away, over or under. Anything else is null.
    """
    margin = F.when(_c(side) == "home", _c(home) - _c(away)).when(_c(side) == "away", _c(away) - _c(home)).cast("double")
    total = (_c(home) + _c(away)).cast("double")
    over = F.when(_c(side) == "over", total - _c(line)).when(_c(side) == "under", _c(line) - total)
    return F.when(_c(market) == "moneyline", margin).when(_c(market) == "spread", margin + _c(line)).when(_c(market) == "total", over)


def settlement(market: Num, side: Num, line: Num, home: Num, away: Num) -> Column:
    """FN-14."""
    e = signed_edge(market, side, line, home, away)
    return F.when(F.abs(e) < 1e-9, "PUSH").when(e > 0, "WIN").when(e < 0, "LOSS")


def graded(market: Num, side: Num, line: Num, home: Num, away: Num, decimal_price: Num) -> Column:
    """FN-13. Struct win, push, profit of a unit stake."""
    s = settlement(market, side, line, home, away)
    profit = F.when(s == "WIN", _c(decimal_price) - 1.0).when(s == "PUSH", 0.0).when(s == "LOSS", -1.0)
    return F.struct((s == "WIN").alias("win"), (s == "PUSH").alias("push"), profit.alias("profit"))


def three_way_value(p_win: Num, p_loss: Num, american: Num) -> Column:
    """FN-15. Expected profit of a unit stake."""
    return _c(p_win) * (american_to_decimal(american) - 1) - _c(p_loss)


def fair_decimal(p_win: Num, p_loss: Num) -> Column:
    """FN-15. Null if the bet cannot win."""
    return F.when(_c(p_win) > 0, 1 + _c(p_loss) / _c(p_win))


def fair_american(p_win: Num, p_loss: Num) -> Column:
    """FN-15."""
    return decimal_to_american(fair_decimal(p_win, p_loss))


def with_ties(p_win: Num, prior_ties: Num, prior_games: Num) -> Column:
    """FN-15. Struct win, push, loss: a two-way probability with the ties seen before, half a tie added."""
    push = (_c(prior_ties) + 0.5) / (_c(prior_games) + 1.0)
    return F.struct(((1 - push) * _c(p_win)).alias("win"), push.alias("push"), ((1 - push) * (1 - _c(p_win))).alias("loss"))


def residual_threshold(market: Num, side: Num, predicted: Num, line: Num) -> Column:
    """FN-16. The residual (actual minus predicted home margin, or total) that decides the bet."""
    gap = _c(line) - _c(predicted)
    return F.when(_c(market) == "total", gap).when(_c(side) == "home", -(_c(predicted) + _c(line))).when(_c(side) == "away", gap)


def residual_direction(side: Num) -> Column:
    """FN-16. Whether the bet wins above (gt) or below (lt) the threshold."""
    return F.when(_c(side).isin("home", "over"), "gt").when(_c(side).isin("away", "under"), "lt")


#: FN-17. Share of a model's edge that each reliability tier keeps. Fixed values.
HAIRCUT = {"HIGH": 1.0, "MEDIUM": 0.70, "LOW": 0.35, "UNSUPPORTED": 0.0}


@dataclass(frozen=True)
class Tiers:
    """FN-17. Bounds of the reliability tiers."""

    farthest: float = 0.10
    low: int = 128
    medium: int = 256
    high: int = 512
    high_radius: float = 0.025
    medium_radius: float = 0.045
    high_disagreement: float = 0.08
    medium_disagreement: float = 0.15


def reliability_tier(support: Num, radius: Num, distance: Num, disagreement: Num, stable: Num, tiers: Tiers = Tiers()) -> Column:
    """FN-17. HIGH, MEDIUM, LOW or UNSUPPORTED; a missing radius is LOW."""
    within = lambda n, r, d: (_c(support) >= n) & (_c(radius) > 0) & (_c(radius) <= r) & (_c(disagreement) <= d)
    young = (_c(support) < tiers.low) | ~F.coalesce(_c(stable), F.lit(False)) | _c(radius).isNull()
    return (
        F.when(_c(distance) > tiers.farthest, "UNSUPPORTED")
        .when(young, "LOW")
        .when(within(tiers.high, tiers.high_radius, tiers.high_disagreement), "HIGH")
        .when(within(tiers.medium, tiers.medium_radius, tiers.medium_disagreement), "MEDIUM")
        .otherwise("LOW")
    )


def unsupported_reason(distance: Num, farthest: float = 0.10) -> Column:
    """FN-17."""
    return F.when(_c(distance) > farthest, "out_of_support")


def uncertainty_factor(radius: Num, scale: float = 0.10) -> Column:
    """FN-17. One at radius 0, zero at the scale and for a missing radius."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), _c(radius) / scale)), F.lit(0.0))


def confidence(tier: Num, radius: Num) -> Column:
    """FN-17, FN-18. The tier's share times the uncertainty factor."""
    kept = F.when(_c(tier) == "HIGH", HAIRCUT["HIGH"]).when(_c(tier) == "MEDIUM", HAIRCUT["MEDIUM"]).when(_c(tier) == "LOW", HAIRCUT["LOW"]).otherwise(0.0)
    return kept * uncertainty_factor(radius)


def staking_probability(model: Num, anchor: Num, tier: Num, radius: Num) -> Column:
    """FN-17. From the market's anchor toward the model by the confidence, clipped."""
    return clip(_c(anchor) + confidence(tier, radius) * (_c(model) - _c(anchor)))


def play_through(supported: Num, value: Num, p: Num, current_break_even: Num, tier: Num, radius: Num, most: float = 0.015) -> Column:
    """FN-18. Struct break_even, american and status: the worst price still worth taking.

    UNSUPPORTED without support; PASS if a number is missing; VALUE over zero; PLAYABLE while the break-even
    is within the concession; else LEAN.
    """
    ok = F.coalesce(_c(supported) & (_c(tier) != "UNSUPPORTED"), F.lit(False))
    whole = _c(value).isNotNull() & _c(p).isNotNull() & _c(current_break_even).isNotNull()
    limit = F.when(ok & whole, F.least(F.lit(0.99), _c(p) + most * confidence(tier, radius)))
    status = F.when(~ok, "UNSUPPORTED").when(~whole, "PASS").when(_c(value) > 0, "VALUE").when(_c(current_break_even) <= limit + 1e-12, "PLAYABLE").otherwise("LEAN")
    return F.struct(limit.alias("break_even"), conservative_american(1 / limit).alias("american"), status.alias("status"))


def offer_flags(market: Num, side: Num, line: Num, price: Num, other_line: Num, other_price: Num) -> Column:
    """FN-19. Struct better_number, better_price (at one number), better_both, worse_or_equal against another offer; null if it is missing.

    A bettor wants a higher spread, a lower line over and a higher line under.
    """
    sign = F.when(_c(side) == "over", -1).otherwise(1)
    gap = F.when(_c(market) == "moneyline", F.lit(0.0)).otherwise(sign * (_c(line) - _c(other_line)))
    price_better = _c(price) > _c(other_price)
    number, same = (gap > 0) & _c(other_price).isNotNull(), (gap == 0) & price_better
    return F.struct(number.alias("better_number"), same.alias("better_price"), (number & price_better).alias("better_both"), (~(number | same)).alias("worse_or_equal"))


def compared(a: Num, b: Num) -> Column:
    """FN-19. BETTER, EQUAL or WORSE."""
    return F.when(_c(a) > _c(b), "BETTER").when(_c(a) == _c(b), "EQUAL").when(_c(a) < _c(b), "WORSE")


def oriented(side: Num, p_home: Num, first: str = "home") -> Column:
    """PRJ-12. A probability of the first side, turned to the row's side."""
    return F.when(_c(side) == first, _c(p_home)).otherwise(1 - _c(p_home))


def bucket(value: Num, edges: list[float], labels: list[str]) -> Column:
    """PRJ-13. The label of the half-open interval [edge, next edge) that holds the value; one label more than edges."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges")
    out = F.when(_c(value).isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(_c(value) < edge, label)
    return out.otherwise(labels[-1])


def in_zone(p: Num, price: Num, p_range: tuple[float, float], price_range: tuple[float, float]) -> Column:
    """PRJ-14. A probability band and a price band, both closed; false if either is null."""
    return F.coalesce(_c(p).between(*p_range) & _c(price).between(*price_range), F.lit(False))


def target(home: Num, away: Num) -> Column:
    """PRJ-15. Struct available, home_win (null on a tie), tie, margin (all null or false before the result)."""
    played = _c(home).isNotNull() & _c(away).isNotNull()
    margin = F.when(played, _c(home) - _c(away))
    return F.struct(played.alias("available"), F.when(margin != 0, margin > 0).alias("home_win"), F.coalesce(margin == 0, F.lit(False)).alias("tie"), margin.alias("margin"))
