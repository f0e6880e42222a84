"""Per-block fits on earlier blocks: ridge effects, logistic maps, market pooling, point markets.

Statistics that add up (normal equations, counts of equal observations) are summed in Spark for each block first, and
a target adds up the blocks before it (by nodes of blocks.prior_nodes, or by pairs): rows are never paired with targets. A group's fit then solves a small dense
system or a one-dimensional problem in numpy. Blocks are independent, so all fit in parallel.
"""

from __future__ import annotations

from functools import reduce
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.odds import ERF, calibrated_probability, pooled_probability
from tidemark.operators.blocks import Prior, node_rows, prior_sums
from tidemark.operators.bootstrap import block_draws
from tidemark.operators.scan import stored


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.0) -> tuple[float, float, str]:
    """weighted_logistic of single rows."""
    return weighted_logistic(x, np.ones_like(x), y, penalty)


def recalibration(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """ML-08. Intercept and slope of the outcome on the logit of the prediction in each group, with status and n.

    Predictions of a group are first reduced to counts by rounded logit (six digits), so a group is as large as its
    different predictions.
    """
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    cells = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.round(F.log(q / (1 - q)), 6).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("hits"))
    kinds = dict(df.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, hits = (pdf[c].to_numpy(float) for c in ("x", "n", "hits"))
        a, b, status = weighted_logistic(x, n, hits)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "intercept": [a], "slope": [b], "status": [status], "n": [int(n.sum())]})

    return cells.groupBy(*by).applyInPandas(fit, ", ".join([*(f"{c} {kinds[c]}" for c in by), "intercept double, slope double, status string, n long"]))


def weighted_logistic(x: np.ndarray, n: np.ndarray, hits: np.ndarray, penalty: float = 0.0, rounds: int = 60) -> tuple[float, float, str]:
    """Intercept and slope of hits among n at x by Newton's method, the slope penalised; CONVERGED, SINGLE_CLASS, CONSTANT, TOO_FEW or DIVERGED."""
    if n.sum() < 2:
        return np.nan, np.nan, "TOO_FEW"
    if hits.sum() in (0, n.sum()):
        return np.nan, np.nan, "SINGLE_CLASS"
    if np.ptp(x) < 1e-12:
        return np.nan, np.nan, "CONSTANT"
    b, m = np.zeros(2), np.column_stack([np.ones_like(x), x])
    for _ in range(rounds):
        p = _sigmoid(m @ b)
        g = m.T @ (n * p - hits) + np.array([0, penalty * b[1]])
        h = (m * (n * p * (1 - p))[:, None]).T @ m + np.diag([1e-12, penalty + 1e-12])
        step = np.linalg.solve(h, g)
        b = b - step
        if not np.isfinite(b).all() or np.abs(b).max() > 1e4:
            return np.nan, np.nan, "DIVERGED"
        if np.abs(step).max() < 1e-10:
            return float(b[0]), float(b[1]), "CONVERGED"
    return np.nan, np.nan, "DIVERGED"


def margin_maps(rows: DataFrame, prior: Prior | DataFrame, x: str, y: str, least: int = 256, penalty: float = 0.0, digits: int = 6) -> DataFrame:
    """ML-06. For each target block the logistic map from x to y on earlier blocks: target, intercept, slope, status, n.

    Blocks are reduced to counts by x, rounded to `digits`, before they meet their targets. Fewer than `least` rows are a
    WARMUP, and a slope that isn't positive a NONPOSITIVE_SLOPE, without numbers; targets without an earlier row have none.
    """
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("block_ord", F.round(x, digits).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("hits"))
    panel = prior_sums(cells, prior, ["x"], ["n", "hits"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        n = int(pdf["n"].sum())
        a, b, status = (np.nan, np.nan, "WARMUP") if n < least else weighted_logistic(*(pdf[c].to_numpy(float) for c in ("x", "n", "hits")), penalty)
        if status == "CONVERGED" and b <= 0:
            a, b, status = np.nan, np.nan, "NONPOSITIVE_SLOPE"
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "intercept": [a], "slope": [b], "status": [status], "n": [n]})

    return panel.groupBy("target").applyInPandas(fit, "target int, intercept double, slope double, status string, n long")


def normal_equations(games: DataFrame, prior: Prior | DataFrame, half_life: float | None = None) -> DataFrame:
    """ML-04. For each target block the weighed normal equations of the score model over earlier blocks: target, i, j and v,
    where j null is the right side, and i and j "" count the games.

    games: block_ord, game_ord (in time), home, away, neutral, home_score, away_score. Each game gives two observations:
    home score = base + home effect unless neutral + offense of home - defense of away, and away score = base + offense of
    away - defense of home, weighed 0.5 ** (age / half_life) by the age back from the latest game before the target.
    Equations are summed once for each node of blocks, weighed from the node's own last game; a target adds up its
    nodes, each times one factor, so games are never paired with targets.
    """
    halved = lambda gap: F.pow(F.lit(0.5), gap / half_life) if half_life else F.lit(1.0)
    played = games.where("home_score is not null and away_score is not null")
    term = lambda name, v: F.struct(name.alias("t"), v.cast("double").alias("v"))
    base = term(F.lit("base"), F.lit(1.0))
    home = term(F.lit("home"), F.when(F.coalesce("neutral", F.lit(False)), 0.0).otherwise(1.0))
    off, con = (lambda c: term(F.concat(F.lit("o:"), F.col(c)), F.lit(1.0))), (lambda c: term(F.concat(F.lit("d:"), F.col(c)), F.lit(-1.0)))
    one = lambda terms, score: F.struct(F.array(*terms).alias("terms"), F.col(score).cast("double").alias("y"))
    both = played.select("block_ord", "game_ord", F.explode(F.array(one([base, home, off("home"), con("away")], "home_score"), one([base, off("away"), con("home")], "away_score"))).alias("ob"))
    ends = played.groupBy("block_ord").agg(F.max("game_ord").alias("block_end"))
    # each term against every term of its observation, and against the score (no second term); a neutral game's home term is named, as zero
    weighed = both.join(ends, "block_ord").withColumn("w", halved(F.col("block_end") - F.col("game_ord")))
    left = weighed.select("block_ord", "w", "ob.y", F.col("ob.terms").alias("terms"), F.explode("ob.terms").alias("a"))
    score = F.struct(F.lit(None).cast("string").alias("t"), F.col("y").alias("v"))
    products = left.select("block_ord", "w", "a", F.explode(F.concat("terms", F.array(score))).alias("b"))
    per = products.groupBy("block_ord", F.col("a.t").alias("i"), F.col("b.t").alias("j")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("v"))
    counts = played.groupBy("block_ord").agg(F.count(F.lit(1)).cast("double").alias("v")).select("block_ord", F.lit("").alias("i"), F.lit("").alias("j"), "v")
    if isinstance(prior, DataFrame):
        nodes = prior.withColumn("node", F.col("source").cast("long")).withColumn("level", F.lit(0)).select("target", "level", "node")
        at = lambda df: df.withColumns({"level": F.lit(0), "node": F.col("block_ord").cast("long")})
    else:
        nodes, at = prior.nodes, lambda df: node_rows(df, prior.levels)
    node_ends = at(ends).groupBy("level", "node").agg(F.max("block_end").alias("node_end"))
    aged = at(per.join(ends, "block_ord")).join(node_ends, ["level", "node"])
    sums = aged.groupBy("level", "node", "i", "j").agg(F.sum(F.col("v") * halved(F.col("node_end") - F.col("block_end"))).alias("v"))
    sums = sums.unionByName(at(counts).groupBy("level", "node", "i", "j").agg(F.sum("v").alias("v")))
    sources = nodes.join(node_ends, ["level", "node"])
    last = sources.groupBy("target").agg(F.max("node_end").alias("last"))
    factors = sources.join(last, "target").select("target", "level", "node", halved(F.col("last") - F.col("node_end")).alias("factor"))
    return sums.join(factors, ["level", "node"]).groupBy("target", "i", "j").agg(F.sum(F.col("v") * F.when(F.col("i") == "", 1.0).otherwise(F.col("factor"))).alias("v"))


def ridge_effects(games: DataFrame, prior: Prior | DataFrame, half_life: float | None = None, penalty: float = 1.0, base: float = 22.5, base_weight: float = 1e-6, least: int = 64, dense: bool = True) -> DataFrame:
    """ML-04. target, term ("base", "home", "o:" and "d:" with an entity) and effect of normal_equations, for targets with `least` earlier games.

    Every effect is drawn to zero by `penalty`, the baseline to `base` by base_weight; then offenses and defenses are
    centred, and the baseline takes up what they lose. dense: a target's system is solved in one task, for some thousands
    of entities; else by conjugate gradients over frames, where no task holds a row of the matrix beyond its own terms.
    """
    panel = normal_equations(games, prior, half_life)
    shrink = lambda name: base_weight if name == "base" else penalty
    if not dense:
        from tidemark.models.linear import solved

        panel = stored(panel, "normal-equations")
        fitted = panel.where((F.col("i") == "") & (F.col("v") >= least)).select("target")
        own = panel.where("i <> ''").join(fitted, "target", "left_semi")
        diagonal = own.where("j is null").select("target", "i", F.col("i").alias("j"), F.when(F.col("i") == "base", base_weight).otherwise(penalty).alias("v"))
        matrix = own.where("j is not null").unionByName(diagonal).groupBy("target", "i", "j").agg(F.sum("v").alias("v"))
        right = own.where("j is null").select("target", "i", (F.col("v") + F.when(F.col("i") == "base", base * base_weight).otherwise(0.0)).alias("v"))
        x = solved(matrix, right, ["target"])
        kind = F.when(F.substring("i", 2, 1) == ":", F.substring("i", 1, 1))
        means = x.where(kind.isNotNull()).groupBy("target", kind.alias("kind")).agg(F.avg("x").alias("mean"))
        both = means.groupBy("target").agg(F.sum(F.when(F.col("kind") == "o", F.col("mean")).otherwise(-F.col("mean"))).alias("up"))
        out = x.withColumn("kind", kind).join(means, ["target", "kind"], "left").join(both, "target", "left")
        effect = F.col("x") - F.coalesce("mean", F.lit(0.0)) + F.when(F.col("i") == "base", F.coalesce("up", F.lit(0.0))).otherwise(0.0)
        return out.select("target", F.col("i").alias("term"), effect.alias("effect"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.loc[pdf["i"] == "", "v"].sum() < least:
            return pd.DataFrame({"target": np.zeros(0, int), "term": np.zeros(0, object), "effect": np.zeros(0)})
        pdf = pdf[pdf["i"] != ""]
        vector, entries = pdf[pdf["j"].isna()], pdf[pdf["j"].notna()]
        names = np.sort(vector["i"].to_numpy())
        at = {n: k for k, n in enumerate(names)}
        m, v = np.zeros((len(names), len(names))), np.zeros(len(names))
        m[entries["i"].map(at), entries["j"].map(at)] = entries["v"]
        v[vector["i"].map(at)] = vector["v"]
        x = np.linalg.solve(m + np.diag([shrink(n) for n in names]), v + np.where(names == "base", base * base_weight, 0.0))
        for kind, sign in (("o:", 1), ("d:", -1)):
            own = np.array([n.startswith(kind) for n in names])
            x[names == "base"] += sign * x[own].mean()
            x[own] -= x[own].mean()
        return pd.DataFrame({"target": pdf["target"].iloc[0], "term": names, "effect": x})

    return panel.groupBy("target").applyInPandas(solve, "target int, term string, effect double")


def expected_points(games: DataFrame, effects: DataFrame) -> DataFrame:
    """ML-05. games with expected_home, expected_away and expected_margin of their own block's fit; unknown entities are average, games without a fit null."""
    base = effects.where(F.col("term").isin("base", "home")).groupBy("target").agg(F.max(F.when(F.col("term") == "base", F.col("effect"))).alias("_base"), F.max(F.when(F.col("term") == "home", F.col("effect"))).alias("_home"))
    out = games.join(base, games["block_ord"] == base["target"], "left").drop("target")
    for side in ("home", "away"):
        for kind in ("o", "d"):
            e = effects.where(F.col("term").startswith(f"{kind}:")).select(F.col("target").alias("block_ord"), F.substring("term", 3, 10_000).alias(side), F.col("effect").alias(f"_{kind}_{side}"))
            out = out.join(e, ["block_ord", side], "left")
    of = lambda c: F.coalesce(c, F.lit(0.0))
    home = F.col("_base") + F.when(F.coalesce("neutral", F.lit(False)), 0.0).otherwise(F.col("_home")) + of("_o_home") - of("_d_away")
    away = F.col("_base") + of("_o_away") - of("_d_home")
    return out.select(*games.columns, home.alias("expected_home"), away.alias("expected_away"), (home - away).alias("expected_margin"))


def margin_chain(games: DataFrame, prior: Prior | DataFrame, half_life: float = 8.0, penalty: float = 1.0, least_games: int = 64, least_rows: int = 256, clip: float = 0.001) -> DataFrame:
    """ML-07. games with expected points and margin, p_home and status: a walk forward in two stages.

    Stage 1 predicts every block's margins by the score model of the blocks before it. Stage 2 maps margins to chances
    by a logistic map fitted on stage 1's own out-of-sample margins of earlier blocks, of games with a result that is no
    tie. status: TEAM_WARMUP (no score model yet), MAP_WARMUP (under least_rows such games), NONPOSITIVE_SLOPE or another
    fault of the map, or FITTED; only then there is a chance, clipped to [clip, 1 - clip].
    """
    staged = stored(expected_points(games, ridge_effects(games, prior, half_life, penalty, least=least_games)), "stage-margins")
    margin = F.col("home_score") - F.col("away_score")
    eligible = staged.where(F.col("expected_margin").isNotNull() & (margin != 0)).select("block_ord", "expected_margin", (margin > 0).cast("int").alias("won"))
    maps = margin_maps(eligible, prior, "expected_margin", "won", least_rows, digits=9)
    joined = staged.join(maps.select(F.col("target").alias("block_ord"), "intercept", "slope", F.col("status").alias("_map")), "block_ord", "left")
    p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("expected_margin"))))
    fitted = (F.col("_map") == "CONVERGED") & F.col("expected_margin").isNotNull()
    status = F.when(F.col("expected_margin").isNull(), "TEAM_WARMUP").when(F.coalesce("_map", F.lit("WARMUP")) == "WARMUP", "MAP_WARMUP").when(F.col("_map") != "CONVERGED", F.col("_map")).otherwise("FITTED")
    return joined.select(*staged.columns, F.when(fitted, F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))).alias("p_home"), status.alias("status"))


def _cells(rows: DataFrame, prior: Prior | DataFrame, columns: dict[str, str], digits: int, sums: dict[str, str] | None = None) -> DataFrame:
    """target, the columns rounded to `digits`, n and sums: the rows of the blocks before each target, equal ones counted.

    Blocks are counted before they meet their targets, so what is paired is as large as a block's different values.
    """
    known = rows.select("block_ord", *(F.col(c).cast("double").alias(name) for name, c in (columns | (sums or {})).items())).dropna()
    by = [F.round(c, digits).alias(c) for c in columns]
    count = [F.sum(c).alias(c) for c in sums or {}]
    per = known.groupBy("block_ord", *by).agg(F.count(F.lit(1)).cast("double").alias("n"), *count)
    return prior_sums(per, prior, list(columns), ["n", *(sums or {})])


def pooling(rows: DataFrame, prior: Prior | DataFrame, model: str, market: str, y: str, least: int = 128, strength: float = 1.0, digits: int = 4) -> DataFrame:
    """ML-09. For each target block on earlier rows: the logistic calibration of the market, and the weight in [0, 1] that the model gets beside it.

    Probabilities are rounded to `digits`, and equal pairs counted by block. The gradient of the loss in the weight is
    monotone; its root is bisected. Not supported with too few rows, one class, or a slope that isn't positive (reason
    says which). extremity_low and _high, gap_low and _high: the range, over these rows, of the calibrated market's distance
    to a half and of the model's to it.
    """
    from_p = lambda p: np.log(np.clip(p, 0.01, 0.99) / (1 - np.clip(p, 0.01, 0.99)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pk", "pm"])  # sums in one order
        pm, pk, n, hits = (pdf[c].to_numpy(float) for c in ("pm", "pk", "n", "y"))
        a = b = w = np.nan
        ranges = [np.nan] * 4
        if n.sum() < least:
            reason = "TOO_FEW"
        else:
            a, b, reason = weighted_logistic(from_p(pk), n, hits, 1 / strength)
            if reason == "CONVERGED" and b <= 0:
                reason = "NONPOSITIVE_SLOPE"
        if reason == "CONVERGED":
            at = from_p(_sigmoid(a + b * from_p(pk)))
            d = from_p(pm) - at
            slope = lambda t: float((d * (n * _sigmoid(at + t * d) - hits)).sum())
            low, high = 0.0, 1.0
            if slope(0.0) >= 0:
                high = 0.0
            elif slope(1.0) <= 0:
                low = 1.0
            while high - low > 1e-12:
                mid = (low + high) / 2
                low, high = (mid, high) if slope(mid) <= 0 else (low, mid)
            w = (low + high) / 2
            fair = _sigmoid(at)
            ranges = [f(x) for x in (np.abs(fair - 0.5), np.abs(pm - fair)) for f in (np.min, np.max)]
        found = {"target": pdf["target"].iloc[0], "intercept": a, "slope": b, "weight": w, "n": int(n.sum()), "supported": reason == "CONVERGED", "reason": reason}
        return pd.DataFrame([found | dict(zip(names, ranges, strict=True))])

    names = ["extremity_low", "extremity_high", "gap_low", "gap_high"]
    panel = _cells(rows, prior, {"pm": model, "pk": market}, digits, {"y": y})
    return panel.groupBy("target").applyInPandas(fit, "target int, intercept double, slope double, weight double, n long, supported boolean, reason string, " + ", ".join(f"{c} double" for c in names))


def pooled(rows: DataFrame, fits: DataFrame, model: str, market: str) -> DataFrame:
    """ML-09, FN-06. rows with the pooled probability of their block's fit, null without one."""
    f = fits.where("supported").select(F.col("target").alias("block_ord"), "intercept", "slope", "weight")
    p = pooled_probability(model, calibrated_probability(market, "intercept", "slope"), "weight")
    return rows.join(f, "block_ord", "left").withColumn("p_pooled", p).drop("intercept", "slope", "weight")


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """functions.odds.normal_cdf for arrays."""
    x = np.abs(z) / 2**0.5
    t = 1 / (1 + ERF["p"] * x)
    tail = 0.5 * t * np.polyval(ERF["a"][::-1], t) * np.exp(-x * x)
    return np.where(z >= 0, 1 - tail, tail)


def _exact_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.fromiter(map(erf, (z / 2**0.5).tolist()), float, len(z)))


def implied_means(line: np.ndarray, p: np.ndarray, sigma: float | np.ndarray) -> np.ndarray:
    """FN-09. The normal mean at which P(above, given no push) is p, for all lines at once: bisection in vectors, then two Newton steps with the exact distribution."""
    push = 0.5 * (np.abs(line - np.round(line)) <= 1e-9)
    p = np.clip(p, 0.01, 0.99)
    low, high = line - 12 * sigma, line + 12 * sigma
    for _ in range(40):
        mid = (low + high) / 2
        loss, win = _normal_cdf((line - push - mid) / sigma), 1 - _normal_cdf((line + push - mid) / sigma)
        up = win / (win + loss) < p
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    mid = (low + high) / 2
    density = lambda z: np.exp(-z * z / 2) / (2 * np.pi) ** 0.5 / sigma
    for _ in range(2):
        below, above = (line - push - mid) / sigma, (line + push - mid) / sigma
        loss, win = _exact_cdf(below), 1 - _exact_cdf(above)
        slope = (density(above) * loss + win * density(below)) / (win + loss) ** 2
        mid = mid - (win / (win + loss) - p) / np.maximum(slope, 1e-12)
    return mid


def with_implied_mean(rows: DataFrame, line: str, p_above: str, sigma: str, name: str) -> DataFrame:
    """FN-09. rows with the implied mean of each line, integer lines included; null where an operand is."""

    @F.pandas_udf("double")
    def mean(t: pd.Series, p: pd.Series, s: pd.Series) -> pd.Series:
        known = t.notna() & p.notna() & s.notna()
        return pd.Series(implied_means(*(x.where(known, 1.0).to_numpy(float) for x in (t, p, s)))).where(known)

    return rows.withColumn(name, mean(*(F.col(c).cast("double") for c in (line, p_above, sigma))))


def weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    """The median of values that occur n times each."""
    order = np.argsort(x, kind="stable")
    ends = np.cumsum(n[order])
    at = np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")
    return float(x[order][at].mean())


def point_states(rows: DataFrame, prior: Prior | DataFrame, model: str, line: str, p_above: str, actual: str, least: int = 128, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """ML-10. For each target block on earlier rows its fit, and the residuals that the fit leaves.

    Fits: target, sigma (robust scale of actual minus line), beta in [0, 1] (the share of the model's distance to the
    market's implied mean that holds), n, reason (FITTED, TOO_FEW, NO_SCALE, or NO_DISAGREEMENT where the model never leaves
    the market), and gap_low and _high, size_low and _high, the ranges of the model's distance and of the line's size.
    Residuals: target, r (actual minus calibrated mean) and n, for fitted targets; made when they are asked for. Values are
    rounded to `digits`. Of a block the fit needs counts of actual minus line, and sums for each line and chance: a task
    holds a target's different distances to the line, never its rows.
    """

    names = {"m": model, "t": line, "p": p_above, "a": actual}
    known = stored(rows.select("block_ord", *(F.col(c).cast("double").alias(k) for k, c in names.items())).dropna().select("block_ord", *(F.round(k, digits).alias(k) for k in names)), "point-rows")
    count = F.count(F.lit(1)).cast("double").alias("n")

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        r, n = pdf["r"].to_numpy(float), pdf["n"].to_numpy(float)
        total, sigma, reason = n.sum(), np.nan, "TOO_FEW"
        if total >= least:
            sigma, reason = 1.4826 * weighted_median(np.abs(r - weighted_median(r, n)), n), None
            if sigma <= 1e-9:
                mean = (n * r).sum() / total
                sigma = float(((n * (r - mean) ** 2).sum() / (total - 1)) ** 0.5)
            if sigma <= 1e-9:
                sigma, reason = np.nan, "NO_SCALE"
        return pd.DataFrame([{"target": pdf["target"].iloc[0], "sigma": sigma, "n": int(total), "why": reason}])

    left = prior_sums(known.groupBy("block_ord", (F.col("a") - F.col("t")).alias("r")).agg(count), prior, ["r"], ["n"])
    scales = stored(left.groupBy("target").applyInPandas(scale, "target int, sigma double, n long, why string"), "point-scales")
    # a line and its chance have one implied mean; products of distances to the line are what the fit needs of their rows
    u, v = F.col("m") - F.col("t"), F.col("a") - F.col("t")
    sums = known.groupBy("block_ord", "t", "p").agg(count, F.sum(u).alias("u"), F.sum(v).alias("v"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"))
    quoted = prior_sums(sums, prior, ["t", "p"], ["n", "u", "v", "uu", "uv"]).join(scales.where("why is null").select("target", "sigma"), "target")
    means = stored(with_implied_mean(quoted, "t", "p", "sigma", "mean"), "point-means")
    g = F.col("mean") - F.col("t")
    fitted = means.groupBy("target").agg(F.sum(F.col("uu") - 2 * g * F.col("u") + F.col("n") * g * g).alias("dd"), F.sum(F.col("uv") - g * (F.col("u") + F.col("v")) + F.col("n") * g * g).alias("da"), F.min(F.abs("t")).alias("size_low"), F.max(F.abs("t")).alias("size_high"))
    far = F.abs(F.col("m") - F.col("mean"))
    asked = means.select("target", "t", "p", "mean")
    if isinstance(prior, Prior):
        # earlier blocks are the first ones: a value is known to every target after its first block
        ends = prior.nodes.groupBy("target").agg(F.max((F.col("node") + 1) * F.pow(F.lit(2.0), "level")).cast("long").alias("_end"))
        met = asked.join(ends, "target").join(known.groupBy("t", "p", "m").agg(F.min("block_ord").alias("_first")), ["t", "p"]).where("_first < _end")
    else:
        met = known.select("block_ord", "t", "p", "m").distinct().join(prior, F.col("block_ord") == F.col("source")).join(asked, ["target", "t", "p"])
    ranges = met.groupBy("target").agg(F.min(far).alias("gap_low"), F.max(far).alias("gap_high"))
    both = scales.join(fitted, "target", "left").join(ranges, "target", "left")
    # the sum of products may leave a rest where every distance is nothing
    moved = F.least("dd", F.col("n") * F.col("gap_high") * F.col("gap_high"))
    reason = F.coalesce("why", F.when(moved <= 1e-12, "NO_DISAGREEMENT").otherwise("FITTED"))
    ok = lambda c: F.when(F.col("reason") == "FITTED", c)
    states = both.withColumn("reason", reason).select("target", F.when(~F.isnan("sigma"), F.col("sigma")).alias("sigma"), ok(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("da") / F.col("dd")))).alias("beta"), "n", "reason", *(ok(F.col(c)).alias(c) for c in ("gap_low", "gap_high", "size_low", "size_high")))
    states = stored(states, "point-states")
    # each row before a target leaves a residual there; they are counted where they are made, and never paired by a shuffle
    cells = known.groupBy("block_ord", "t", "p", "m", "a").agg(F.count(F.lit(1)).alias("n"))
    of = asked.join(states.where("reason = 'FITTED'").select("target", "beta"), "target")
    if isinstance(prior, Prior):
        later = of.join(ends, "target").groupBy("t", "p").agg(F.collect_list(F.struct("target", "mean", "beta", "_end")).alias("_of"))
        paired = cells.join(later, ["t", "p"]).select("*", F.explode(F.filter("_of", lambda x: x["_end"] > F.col("block_ord"))).alias("_x")).select("t", "p", "m", "a", "n", "_x.target", "_x.mean", "_x.beta")
    else:
        paired = cells.join(prior, F.col("block_ord") == F.col("source")).join(of, ["target", "t", "p"])
    rest = F.col("a") - (F.col("mean") + F.col("beta") * (F.col("m") - F.col("mean")))
    residual = F.rint(rest * 10.0**digits) / 10.0**digits + 0.0
    return states, paired.groupBy("target", residual.alias("r")).agg(F.sum("n").alias("n"))


def point_fits(rows: DataFrame, prior: Prior | DataFrame, model: str, line: str, p_above: str, actual: str, least: int = 128, digits: int = 4) -> DataFrame:
    """ML-10. The fits of point_states."""
    return point_states(rows, prior, model, line, p_above, actual, least, digits)[0]


def ridge_panel(rows: DataFrame, prior: Prior | DataFrame, numbers: list[str], categories: list[str], y: str, alphas: list[float], keys: list[str], least: int = 50, digits: int = 6) -> DataFrame:
    """ML-11. Predictions of each target block by a ridge on earlier blocks, for each alpha: medians for nulls, standardised numbers, one-hot categories.

    A block is reduced to the products of its terms (each number with zero for null, whether it is null, each category,
    the target and one) and to counts of each number's values, rounded to `digits`, for the medians. A target adds up
    both, puts its own medians into the products, and solves one system for each alpha; its rows are predicted
    by a join with the solution. Categories that earlier blocks lack, and nulls among them, weigh nothing.
    """
    train = rows.where(F.col(y).isNotNull())
    term = lambda name, v: F.struct(name.alias("t"), v.cast("double").alias("v"))
    some = F.filter(F.array(
        term(F.lit("1"), F.lit(1.0)), term(F.lit("y"), F.col(y)),
        *(term(F.lit(f"v:{c}"), F.col(c)) for c in numbers), *(term(F.lit(f"m:{c}"), F.when(F.col(c).isNull(), 1.0)) for c in numbers),
        *(term(F.concat(F.lit(f"c:{c}="), F.col(c).cast("string")), F.when(F.col(c).isNotNull(), 1.0)) for c in categories),
    ), lambda x: x["v"].isNotNull() & (x["v"] != 0))
    left = train.select("block_ord", some.alias("terms")).select("block_ord", "terms", F.explode("terms").alias("a"))
    products = left.select("block_ord", "a", F.explode("terms").alias("b")).groupBy("block_ord", F.col("a.t").alias("i"), F.col("b.t").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))
    values = train.select("block_ord", F.explode(F.array(*(F.struct(F.lit(f"v:{c}").alias("i"), F.round(F.col(c).cast("double"), digits).alias("x")) for c in numbers))).alias("e")).where("e.x is not null")
    counts = values.groupBy("block_ord", F.col("e.i").alias("i"), F.col("e.x").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    both = products.withColumn("x", F.lit(None).cast("double")).unionByName(counts.withColumn("j", F.lit(None).cast("string")))
    panel = prior_sums(both, prior, ["i", "j", "x"], ["v"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram, counted = pdf[pdf["j"].notna()], pdf[pdf["j"].isna()]
        names = sorted({"1", "y"} | set(gram["i"]) | {f"{k}:{c}" for k in "vm" for c in numbers})
        at = {n: k for k, n in enumerate(names)}
        g = np.zeros((len(names), len(names)))
        g[gram["i"].map(at), gram["j"].map(at)] = gram["v"]
        n = g[at["1"], at["1"]]
        if n < least:
            return pd.DataFrame({"target": np.zeros(0, int), "alpha": np.zeros(0), "term": np.zeros(0, object), "weight": np.zeros(0), "middle": np.zeros(0)})
        # columns of the design as combinations of the terms
        levels = [t for t in names if t.startswith("c:")]
        middles, mix = [], np.zeros((len(names), len(numbers) + len(levels)))
        for k, c in enumerate(numbers):
            own = counted[counted["i"] == f"v:{c}"]
            middles.append(weighted_median(own["x"].to_numpy(float), own["v"].to_numpy(float)) if len(own) else 0.0)
            mix[at[f"v:{c}"], k], mix[at[f"m:{c}"], k] = 1, middles[k]
        for k, t in enumerate(levels):
            mix[at[t], len(numbers) + k] = 1
        centre, base = mix.T @ g[:, at["1"]] / n, g[at["y"], at["1"]] / n
        xx = mix.T @ g @ mix - n * np.outer(centre, centre)
        xy = mix.T @ g[:, at["y"]] - n * centre * base
        dev = np.ones(len(centre))
        own = np.sqrt(np.maximum(np.diag(xx)[: len(numbers)], 0) / n)
        dev[: len(numbers)] = np.where(own > 1e-12, own, 1.0)
        out = []
        for alpha in alphas:
            w = np.linalg.solve(xx / np.outer(dev, dev) + alpha * np.eye(len(dev)), xy / dev) / dev
            out.append(("1", base - float(centre @ w), 0.0, alpha))
            out += [(t, x, m, alpha) for t, x, m in zip([*(f"v:{c}" for c in numbers), *levels], w.tolist(), [*middles, *[0.0] * len(levels)], strict=True)]
        terms, x, m, alpha = (np.array(c, object if k == 0 else float) for k, c in enumerate(zip(*out, strict=True)))
        return pd.DataFrame({"target": pdf["target"].iloc[0], "alpha": alpha, "term": terms, "weight": x, "middle": m})

    weights = panel.groupBy("target").applyInPandas(solve, "target int, alpha double, term string, weight double, middle double")
    solved = weights.groupBy("target", "alpha").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("weight", "middle")))).alias("_w"))
    # one row a block and alpha
    tests = rows.select(F.col("block_ord").alias("target"), *keys, *numbers, *categories, F.col(y).cast("double").alias("actual"), F.explode(F.array(*(F.lit(float(x)) for x in alphas))).alias("alpha"))
    joined = tests.join(solved, ["target", "alpha"], "left")
    of = lambda t: F.try_element_at("_w", t)
    predicted = of(F.lit("1"))["weight"]
    for c in numbers:
        predicted = predicted + of(F.lit(f"v:{c}"))["weight"] * F.coalesce(F.col(c).cast("double"), of(F.lit(f"v:{c}"))["middle"])
    for c in categories:
        predicted = predicted + F.coalesce(of(F.concat(F.lit(f"c:{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))))["weight"], F.lit(0.0))
    return joined.select("target", "alpha", *keys, "actual", predicted.alias("predicted"))


def boosted_panel(rows: DataFrame, features: list[str], y: str, validation: int = 2, least_validation: int = 21, fit_blocks: int = 2, least_fit: int = 32, most_rounds: int = 20, depth: int = 3, seed: int = 7) -> DataFrame:
    """ML-12. A walk-forward panel of boosted trees: every row with p_boosted, status and warmup_reason.

    Of each target block the blocks before it are split into fit and validation blocks (blocks.fit_split, which also
    says what is warm-up). Trees are fitted on the fit blocks, the number of rounds is the one with the least loss on
    the validation blocks, and a refit on both with so many rounds scores the target. A fit with one class is a warm-up.
    Nulls are medians of the training rows. The learner is Spark ML's gradient-boosted trees, which trains over
    partitions; the driver loops over the blocks of the calendar, a bounded list, and rows stay in Spark.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidemark.operators import blocks

    # written once: every training reads it
    rows = stored(rows, "panel-rows")
    split = blocks.fit_split(rows, F.col(y).isNotNull(), validation, least_validation, fit_blocks, least_fit)
    names = [f"_f_{c}" for c in features]
    cast = rows.select("*", *(F.col(c).cast("double").alias(f"_f_{c}") for c in features), F.col(y).cast("double").alias("_y"))
    pack = VectorAssembler(inputCols=[f"{n}_i" for n in names], outputCol="_x")

    def trained(train: DataFrame, rounds: int):
        imputer = Imputer(inputCols=names, outputCols=[f"{n}_i" for n in names], strategy="median").fit(train)
        packed = lambda df: pack.transform(imputer.transform(df))
        return packed, GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=seed).fit(packed(train))

    out = []
    for b in split.orderBy("block_ord").collect():
        known = cast.where((F.col("block_ord") < b.block_ord) & F.col("_y").isNotNull())
        target = cast.where(F.col("block_ord") == b.block_ord)
        reason, p = b.warmup_reason, F.lit(None).cast("double")
        if reason is None:
            fit, valid = known.where(F.col("block_ord") <= b.fit_last), known.where(F.col("block_ord") >= b.validate_first)
            if fit.agg(F.count_distinct("_y")).first()[0] < 2:
                reason = "single_class"
            else:
                packed, model = trained(fit, most_rounds)
                losses = model.evaluateEachIteration(packed(valid)) if valid.limit(1).count() else []
                packed, model = trained(known, 1 + losses.index(min(losses)) if losses else most_rounds)
                target = model.transform(packed(target))
                p = vector_to_array("probability")[1]
        out.append(target.select(*rows.columns, p.alias("p_boosted"), F.lit("FITTED" if reason is None else "WARMUP").alias("status"), F.lit(reason).cast("string").alias("warmup_reason")))
    return reduce(DataFrame.unionByName, out) if out else rows.select("*", F.lit(None).cast("double").alias("p_boosted"), F.lit("WARMUP").alias("status"), F.lit("no_block").alias("warmup_reason"))


def reliability_states(losses: DataFrame, block: str = "block_ord", least_rows: int = 128, least_blocks: int = 4, most: float = 0.05, replicates: int = 1000, quantile: float = 0.9, seed: int = 0) -> DataFrame:
    """ML-14, AG-31. For each block, on strictly earlier ones: support (rows), n_blocks, radius and stable.

    losses: block, gap (prediction minus outcome). The radius is a quantile of the absolute mean gap over `replicates` draws
    of as many blocks with replacement (the value at place round((replicates - 1) * quantile)); 0.10 where there are fewer
    than two blocks, null under least_rows rows. Stable: at least least_blocks blocks, and a radius of `most` or less.
    Rows are summed by block before anything is paired; a target gets the sums of its earlier blocks, and its draws, of a
    counter's hash, are made in its task, as many at a time as fit. Blocks without a gap count nowhere.
    """
    sums = losses.where("gap is not null").groupBy(block).agg(F.sum("gap").alias("g"), F.count("gap").alias("n"))
    numbered = losses.select(block).distinct().join(sums, block, "left").withColumn("b", (F.row_number().over(Window.orderBy(block)) - 1).cast("long"))  # one row a block
    earlier = numbered.where("n is not null").select(F.col("b").alias("source"), "g", "n")
    pairs = numbered.select(F.col("b").alias("target")).join(earlier, F.col("source") < F.col("target"))

    def radius(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        g, n = pdf["g"].to_numpy(float), pdf["n"].to_numpy(float)
        found = np.nan
        if n.sum() >= least_rows:
            means = [np.abs(g[k].sum(1) / n[k].sum(1)) for k in block_draws(len(g), replicates, seed)]
            found = float(np.sort(np.concatenate(means))[round((replicates - 1) * quantile)]) if len(g) > 1 else 0.10
        return pd.DataFrame({"target": [pdf["target"].iloc[0]], "support": [int(n.sum())], "n_blocks": [len(g)], "radius": [found]})

    made = pairs.groupBy("target").applyInPandas(radius, "target long, support long, n_blocks long, radius double")
    out = numbered.join(made, numbered["b"] == made["target"], "left")
    r = F.when(~F.isnan("radius"), F.col("radius"))
    stable = F.coalesce((F.col("n_blocks") >= least_blocks) & (r <= most), F.lit(False))
    return out.select(block, F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), r.alias("radius"), stable.alias("stable"))
