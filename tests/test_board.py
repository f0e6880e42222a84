"""The offer board against a plain loop that follows the written rules."""

import math

import numpy as np
import pytest

from test_fits import lattice, logit, plain_draws

from tidemark.models import fits
from tidemark.plans import pipelines

SCHEMA = "game int, block_ord int, book string, market string, side string, line double, price int, home_score int, away_score int"


def offers_and_models(seed=2):
    rng = np.random.default_rng(seed)
    games, quotes = [], []
    for g in range(600):
        b = g // 50
        h, a = int(rng.integers(0, 40)), int(rng.integers(0, 40))
        pa, pb = (float(np.round(rng.uniform(0.2, 0.8), 3)) for _ in "ab")
        games.append((g, pa, pb, (pa + pb) / 2, float(np.round(rng.normal(0, 6), 1)), float(np.round(rng.normal(42, 6), 1))))
        for market, sides, line in (("moneyline", ("home", "away"), None), ("spread", ("home", "away"), float(rng.integers(-14, 14)) / 2), ("total", ("over", "under"), 35.0 + float(rng.integers(0, 20)) / 2)):
            for k, s in enumerate(sides):
                quotes.append((g, b, "b0", market, s, None if line is None else -line if market == "spread" and k else line, int(rng.integers(-130, -100)), h, a))
    return games, quotes


MODELS = "game int, p_home_a double, p_home_b double, p_home double, margin double, total double"


@pytest.fixture(scope="module")
def board(spark):
    games, quotes = offers_and_models()
    models = spark.createDataFrame(games, MODELS)

    def run(q):
        made = pipelines.offer_board(spark.createDataFrame(q, SCHEMA), models, ["b0"])
        return {(r.game, r.market, r.side): r for r in made.collect()}

    return run


def decimal(price):
    return 1 + 100 / -price if price < 0 else 1 + price / 100


def outside(value, values):
    low, high = min(values), max(values)
    return max(low - value, value - high, 0.0) / max(high - low, 1e-6)


def test_board_equals_a_plain_loop(board):
    games, quotes = offers_and_models()
    got = board(quotes)
    assert len(got) == len(quotes)
    model = {g[0]: g for g in games}
    fair = {}
    for q in quotes:
        fair.setdefault(q[0], {}).setdefault(q[3], {})[q[4]] = q
    no_vig = lambda g, m, s: (1 / decimal(fair[g][m][s][6])) / sum(1 / decimal(x[6]) for x in fair[g][m].values())
    first = {"moneyline": "home", "spread": "home", "total": "over"}
    reliability = {m: [] for m in first}  # (block, p - y) of what was evaluated, block by block
    tiers = set()
    for b in range(12):
        past = [g for g in range(600) if g // 50 < b]
        for market in first:
            lead = first[market]
            rows = [(g, fair[g][market][lead]) for g in past]
            result = lambda q: q[7] - q[8] if q[3] != "total" else q[7] + q[8]
            state = None
            if market == "moneyline":
                rows = [(g, q) for g, q in rows if q[7] != q[8]]
                if len(rows) >= 128:
                    pm = np.round([model[g][3] for g, _ in rows], 4)
                    pk = np.round([no_vig(g, market, lead) for g, _ in rows], 4)
                    y = np.array([float(q[7] > q[8]) for _, q in rows])
                    a, s, why = fits.logistic(logit(pk), y, 1.0)
                    if why == "CONVERGED" and s > 0:
                        cal = 1 / (1 + np.exp(-(a + s * logit(pk))))
                        at, d = logit(cal), logit(pm) - logit(cal)
                        grad = lambda w: (d * (1 / (1 + np.exp(-(at + w * d))) - y)).sum()  # noqa: B023, E731
                        low, high = (0.0, 0.0) if grad(0) >= 0 else (1.0, 1.0) if grad(1) <= 0 else (0.0, 1.0)
                        while high - low > 1e-12:
                            mid = (low + high) / 2
                            low, high = (mid, high) if grad(mid) <= 0 else (low, mid)
                        state = a, s, (low + high) / 2, np.abs(cal - 0.5), np.abs(pm - cal), [abs(model[g][1] - model[g][2]) for g, _ in rows]
            elif len(rows) >= 128:
                expected = np.array([model[g][4 if market == "spread" else 5] for g, _ in rows])
                t = np.array([-q[5] if market == "spread" else q[5] for _, q in rows])
                pk = np.round([no_vig(g, market, lead) for g, _ in rows], 4)
                actual = np.array([float(result(q)) for _, q in rows])
                sigma = 1.4826 * np.median(np.abs(actual - t - np.median(actual - t)))
                mean = fits.implied_means(t, pk, sigma)
                d = expected - mean
                beta = float(np.clip((d * (actual - mean)).sum() / (d * d).sum(), 0, 1))
                state = sigma, beta, np.round(actual - (mean + beta * d), 4), np.abs(d), np.abs(t)
            seen = [x for x in reliability[market] if x[0] < b]
            blocks_ = sorted({x[0] for x in seen})
            radius, stable = None, False
            if len(seen) >= 128:
                sums = [(sum(x[1] for x in seen if x[0] == k), sum(x[0] == k for x in seen)) for k in blocks_]
                values = sorted(abs(sum(sums[k][0] for k in draw) / sum(sums[k][1] for k in draw)) for draw in plain_draws(len(sums), 1000, 0)) if len(sums) > 1 else None
                radius = values[round(999 * 0.9)] if values else 0.10
                stable = len(sums) >= 4 and radius <= 0.05
            ties = sum(fair[g][market][lead][7] == fair[g][market][lead][8] for g in past)
            for g in range(b * 50, b * 50 + 50):
                for side, q in fair[g][market].items():
                    r = got[g, market, side]
                    if state is None:
                        assert (r.p_win, r.tier, r.status, r.support) == (None, "UNSUPPORTED", "PASS", 0) and r.reason is not None
                        continue
                    if market == "moneyline":
                        a, s, w, extreme, gaps, parts = state
                        cal = 1 / (1 + math.exp(-(a + s * logit(no_vig(g, market, "home")))))
                        p = 1 / (1 + math.exp(-(logit(cal) + w * (logit(model[g][3]) - logit(cal)))))
                        push = (ties + 0.5) / (len(past) + 1)
                        p = p if side == "home" else 1 - p
                        want = (1 - push) * p, push, (1 - push) * (1 - p)
                        part = abs(model[g][1] - model[g][2])
                        distance = max(outside(abs(cal - 0.5), extreme), outside(abs(model[g][3] - cal), gaps), outside(part, parts))
                        n, tolerance = len(extreme), 2e-4
                    else:
                        sigma, beta, left, gaps, sizes = state
                        at = -fair[g][market]["home"][5] if market == "spread" else q[5]
                        value = model[g][4 if market == "spread" else 5]
                        mu = float(fits.implied_means(np.array([at]), np.array([no_vig(g, market, lead)]), sigma)[0])
                        want = lattice(left.tolist(), market, side, mu + beta * (value - mu), q[5])
                        distance, part = max(outside(abs(value - mu), gaps), outside(abs(q[5]), sizes)), 0.0
                        n, tolerance = len(gaps), 2.1 / len(gaps)  # a residual may be at the edge of a cell
                    assert (r.p_win, r.p_push, r.p_loss) == pytest.approx(want, abs=tolerance)
                    assert r.p_win + r.p_push + r.p_loss == pytest.approx(1)
                    support = min(n, len(seen))
                    assert r.support == support and r.distance == pytest.approx(distance, abs=2e-3)
                    if abs(distance - 0.10) > 0.01:
                        young = support < 128 or not stable or radius is None
                        high, medium = support >= 512 and 0 < (radius or 0) <= 0.025 and part <= 0.08, support >= 256 and (radius or 1) <= 0.045 and part <= 0.15
                        tier = "UNSUPPORTED" if distance > 0.10 else "LOW" if young else "HIGH" if high else "MEDIUM" if medium else "LOW"
                        if radius is None or all(abs(radius - x) > 2e-3 for x in (0.025, 0.045, 0.05)):
                            assert r.tier == tier
                    assert r.value == pytest.approx(r.p_win * (decimal(q[6]) - 1) - r.p_loss)
                    tiers.add(r.tier)
                    if side == lead and r.settled in ("WIN", "LOSS"):
                        reliability[market].append((b, r.p_win / (r.p_win + r.p_loss) - (r.settled == "WIN")))
    assert len(tiers) > 1


def test_later_results_change_nothing_before_them(board):
    _, quotes = offers_and_models()
    got, late = board(quotes), board([q if q[1] < 8 else (*q[:7], 1, 30) for q in quotes])
    assert all((late[k].p_win, late[k].tier, late[k].distance) == (r.p_win, r.tier, r.distance) for k, r in got.items() if r.block_ord <= 8)


def test_a_biased_model_has_no_high_tier(spark):
    """Every spread of 20 points is won by far less than the model says; nothing of it is stable."""
    rng = np.random.default_rng(4)
    games, quotes = [], []
    for g in range(900):
        h = int(rng.integers(10, 20))
        games.append((g, 0.9, 0.9, 0.9, 30.0 + g % 7, 60.0))
        quotes += [(g, g // 60, "b0", "moneyline", s, None, -110, h, h + 1 + g % 3) for s in ("home", "away")]
    made = pipelines.offer_board(spark.createDataFrame(quotes, SCHEMA), spark.createDataFrame(games, MODELS), ["b0"]).collect()
    assert {r.tier for r in made} <= {"UNSUPPORTED", "LOW"}
