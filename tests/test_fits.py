"""Fits of earlier blocks, resampling and rating states against plain loops that follow the written rules, not the code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import Rating
from tidemark.models import fits, linear, ratings
from tidemark.operators import blocks, bootstrap, offers
from tidemark.operators import evaluation as ev

GAMES = "block_ord int, game_ord int, home string, away string, neutral boolean, home_score int, away_score int"


def league(n_blocks=24, seed=3):
    rng = random.Random(seed)
    strength = {t: rng.gauss(0, 5) for t in "abcdefgh"}
    rows, k = [], 0
    for b in range(n_blocks):
        teams = rng.sample("abcdefgh", 8)
        for j in range(4):
            h, a = teams[2 * j], teams[2 * j + 1]
            scores = [max(0, round(20 + strength[x] + rng.gauss(2 * (i == 0), 6))) for i, x in enumerate((h, a))]
            rows.append((b + 3, k, h, a, j == 0, *(scores if b < n_blocks - 1 else (None, None))))
            k += 1
    return rows


def plain_effects(past, half_life, ridge):
    """Appendix A: y_home = mu + h (not neutral) + off_home - def_away, y_away = mu + off_away - def_home, ridge on every effect, prior mean 22.5."""
    teams = sorted({t for g in past for t in g[2:4]})
    names = ["base", "home", *(f"o:{t}" for t in teams), *(f"d:{t}" for t in teams)]
    at = {n: k for k, n in enumerate(names)}
    m, v = np.zeros((len(names),) * 2), np.zeros(len(names))
    newest = max(g[1] for g in past)
    for _, k, h, a, neutral, hs, as_ in past:
        for me, other, bonus, score in ((h, a, 0.0 if neutral else 1.0, hs), (a, h, 0.0, as_)):
            x = np.zeros(len(names))
            x[at["base"]], x[at["home"]], x[at[f"o:{me}"]], x[at[f"d:{other}"]] = 1, bonus, 1, -1
            w = 0.5 ** ((newest - k) / half_life)
            m += w * np.outer(x, x)
            v += w * score * x
    m += np.diag([1e-6 if n == "base" else ridge for n in names])
    v[0] += 1e-6 * 22.5
    x = np.linalg.solve(m, v)
    off, con = x[2 : 2 + len(teams)], x[2 + len(teams) :]
    x[0] += off.mean() - con.mean()
    off -= off.mean()
    con -= con.mean()
    return dict(zip(names, x, strict=True))


@pytest.mark.parametrize("kind", ["pairs", "nodes", "gradients"])
def test_ridge_effects(spark, kind):
    rows = league()
    g = spark.createDataFrame(rows, GAMES).repartition(3)
    calendar = g.select("block_ord").distinct()
    prior = blocks.prior_pairs(calendar) if kind == "pairs" else blocks.prior_nodes(calendar)
    if kind == "gradients":  # a few targets, as each round is a handful of jobs
        prior.nodes = prior.nodes.where("target in (20, 26)")
    got = {(r.target, r.term): r.effect for r in fits.ridge_effects(g, prior, half_life=8.0, penalty=1.0, dense=kind != "gradients").collect()}
    assert {t for t, _ in got} == ({20, 26} if kind == "gradients" else set(range(19, 27)))  # 64 games are 16 blocks
    for target in sorted({t for t, _ in got}):
        want = plain_effects([x for x in rows if x[0] < target and x[5] is not None], 8.0, 1.0)
        assert {n: got[target, n] for n in want} == pytest.approx(want, abs=1e-6)


def logistic(x, y):
    b = np.zeros(2)
    m = np.column_stack([np.ones(len(x)), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-m @ b))
        b = b - np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m, m.T @ (p - y))
    return b


def test_margin_chain(spark):
    """Out-of-sample margins of stage 1 are what stage 2 learns from; each block sees earlier ones alone."""
    rows = league(60)
    g = spark.createDataFrame(rows, GAMES).repartition(3)
    got = {r.game_ord: r for r in fits.margin_chain(g, blocks.prior_nodes(g.select("block_ord").distinct()), 8.0, 1.0, least_rows=100).collect()}
    assert len(got) == len(rows)
    margins, seen = {}, set()
    for b in sorted({x[0] for x in rows}):
        past = [x for x in rows if x[0] < b and x[5] is not None]
        known = [x for x in past if x[1] in margins and x[5] != x[6]]
        effects = plain_effects(past, 8.0, 1.0) if len(past) >= 64 else None
        line = logistic(np.array([margins[x[1]] for x in known]), np.array([float(x[5] > x[6]) for x in known])) if len(known) >= 100 else None
        for x in [x for x in rows if x[0] == b]:
            r = got[x[1]]
            if effects is None:
                assert r.expected_margin is None and r.p_home is None and r.status == "TEAM_WARMUP"
                seen.add(r.status)
                continue
            e = lambda n: effects.get(n, 0.0)  # noqa: E731, B023
            home = effects["base"] + (0 if x[4] else effects["home"]) + e(f"o:{x[2]}") - e(f"d:{x[3]}")
            away = effects["base"] + e(f"o:{x[3]}") - e(f"d:{x[2]}")
            margins[x[1]] = home - away
            assert (r.expected_home, r.expected_away, r.expected_margin) == pytest.approx((home, away, home - away), abs=1e-6)
            want = "MAP_WARMUP" if line is None else "NONPOSITIVE_SLOPE" if line[1] <= 0 else "FITTED"
            seen.add(want)
            assert r.status == want
            if want == "FITTED":
                assert r.p_home == pytest.approx(min(0.999, max(0.001, 1 / (1 + math.exp(-(line[0] + line[1] * (home - away)))))), abs=1e-5)
            else:
                assert r.p_home is None
    assert {"TEAM_WARMUP", "MAP_WARMUP", "FITTED"} <= seen


@pytest.mark.parametrize("blocks_", [[0, 1, 2, 3, 4, 5, 6, 7, 8], [5, 9, 100, 101, 128, 255, 256, 1000]])
def test_nodes_equal_pairs(spark, blocks_):
    rng = random.Random(1)
    per = spark.createDataFrame([(b, rng.choice("xyz"), rng.randrange(9)) for b in blocks_ for _ in range(4)], "block_ord int, c string, v int")
    calendar = per.select("block_ord").distinct()
    nodes, pairs = blocks.prior_nodes(calendar), blocks.prior_pairs(calendar)
    rows = lambda p: sorted(map(tuple, blocks.prior_sums(per, p, ["c"], ["v"]).collect()))
    assert rows(nodes) == rows(pairs)
    assert nodes.nodes.groupBy("target").count().agg(F.max("count")).first()[0] <= nodes.levels


def test_nodes_see_what_is_available(spark):
    rows = [(0, 10, 12), (1, 20, 31), (2, 30, 32), (3, 40, 41), (4, 41, 60), (5, 61, 70)]
    calendar = spark.createDataFrame(rows, "block_ord int, cut int, avail int")
    per = calendar.select("block_ord", F.lit(1).alias("n"), F.col("block_ord").alias("v"))
    nodes = blocks.prior_nodes(calendar, as_of="cut", available_at="avail")
    pairs = blocks.prior_pairs(calendar, as_of="cut", available_at="avail")
    rows_of = lambda p: sorted(map(tuple, blocks.prior_sums(per, p, [], ["n", "v"]).collect()))
    assert rows_of(nodes) == rows_of(pairs) == [(1, 1, 0), (2, 1, 0), (3, 3, 3), (4, 4, 6), (5, 5, 10)]
    with pytest.raises(ValueError):
        blocks.prior_nodes(spark.createDataFrame([(0, 1, 9), (1, 2, 3)], calendar.schema), as_of="cut", available_at="avail")


def test_fit_split_gates(spark):
    sizes = {2: 20, 3: 1, 5: 30, 6: 0, 7: 15, 8: 5, 9: 15, 10: 9, 12: 4}
    df = spark.createDataFrame([(b, k < n) for b, n in sizes.items() for k in range(max(n, 1))], "block_ord int, done boolean")
    got = {r.block_ord: r for r in blocks.fit_split(df, F.col("done")).collect()}
    for b in sizes:
        past = [(x, n) for x, n in sizes.items() if x < b and n]
        valid, fit = past[-2:], past[:-2]
        why = "too_few_validation_blocks" if len(valid) < 2 else "too_few_validation_rows" if sum(n for _, n in valid) < 21 else "too_few_fit_blocks" if len(fit) < 2 else "too_few_fit_rows" if sum(n for _, n in fit) < 32 else None
        assert tuple(got[b])[1:] == ((fit[-1][0], valid[0][0], valid[1][0], None) if why is None else (None, None, None, why))
    assert {r.warmup_reason for r in got.values()} >= {None, "too_few_validation_blocks", "too_few_validation_rows", "too_few_fit_blocks"}


def logit(p):
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def test_pooling_and_point_states(spark):
    rng = np.random.default_rng(8)
    rows = []
    for b in range(5):
        for _ in range(80):
            p = float(np.round(rng.uniform(0.1, 0.9), 3))
            rows.append((b, float(np.round(np.clip(p + rng.normal(0, 0.1), 0.02, 0.98), 3)), p, int(rng.random() < p), float(rng.integers(-20, 20)) / 2, float(rng.integers(-15, 15)), float(np.round(rng.normal(0, 5), 2))))
    df = spark.createDataFrame(rows, "block_ord int, m double, k double, y int, t double, a double, e double").repartition(2)
    prior = blocks.prior_nodes(df.select("block_ord").distinct())
    pools = {r.target: r for r in fits.pooling(df, prior, "m", "k", "y").collect()}
    assert set(pools) == {1, 2, 3, 4} and pools[1].reason == "TOO_FEW"
    for target in (2, 3, 4):
        r, train = pools[target], [x for x in rows if x[0] < target]
        pm, pk, y = (np.array([x[c] for x in train], float) for c in (1, 2, 3))
        a, b, _ = fits.logistic(logit(pk), y, 1.0)
        fair = 1 / (1 + np.exp(-(a + b * logit(pk))))
        at = logit(fair)
        grid = np.linspace(0, 1, 10001)
        loss = [np.mean(np.log1p(np.exp(at + w * (logit(pm) - at))) - y * (at + w * (logit(pm) - at))) for w in grid]
        assert r.supported and (r.n, r.intercept, r.slope) == pytest.approx((len(train), a, b), abs=1e-7) and r.weight == pytest.approx(grid[int(np.argmin(loss))], abs=2e-4)
        far, gap = np.abs(fair - 0.5), np.abs(pm - fair)
        assert (r.extremity_low, r.extremity_high, r.gap_low, r.gap_high) == pytest.approx((far.min(), far.max(), gap.min(), gap.max()), abs=1e-6)
    states, residuals = fits.point_states(df, prior, "e", "t", "k", "a")
    left = {}
    for r in residuals.collect():
        left.setdefault(r.target, []).extend([r.r] * r.n)
    for r in states.collect():
        train = [x for x in rows if x[0] < r.target]
        if len(train) < 128:
            assert r.reason == "TOO_FEW" and r.target not in left
            continue
        e, t, p, a = (np.array([x[c] for x in train], float) for c in (6, 4, 2, 5))
        res = a - t
        sigma = 1.4826 * np.median(np.abs(res - np.median(res)))
        mean = fits.implied_means(t, p, sigma)
        d = e - mean
        beta = np.clip((d * (a - mean)).sum() / (d**2).sum(), 0, 1)
        assert r.reason == "FITTED" and (r.sigma, r.beta, r.n) == pytest.approx((sigma, beta, len(train)), abs=1e-7)
        assert (r.gap_low, r.gap_high, r.size_low, r.size_high) == pytest.approx((np.abs(d).min(), np.abs(d).max(), np.abs(t).min(), np.abs(t).max()), abs=1e-6)
        assert sorted(left[r.target]) == pytest.approx(sorted(a - (mean + beta * d)), abs=1e-4)


def test_a_model_that_never_leaves_the_market_has_no_state(spark):
    t = np.arange(200) % 7 + 0.5
    rows = [(0, float(x), float(x), 0.5, float((k * 13) % 11)) for k, x in enumerate(t)] + [(1, 1.0, 1.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "block_ord int, m double, t double, p double, a double")
    states, residuals = fits.point_states(df, blocks.prior_nodes(df.select("block_ord").distinct()), "m", "t", "p", "a")
    assert [(r.reason, r.beta) for r in states.collect()] == [("NO_DISAGREEMENT", None)] or math.isnan(states.first().beta)
    assert residuals.count() == 0


def lattice(residuals, market, side, predicted, line):
    """Appendix A: the push cell [t - .5, t + .5) on integer lines, Jeffreys half counts."""
    t = line - predicted if market == "total" or side == "away" else -(predicted + line)
    up = side in ("home", "over")
    if abs(line - round(line)) <= 1e-9:
        push = sum(t - 0.5 <= r < t + 0.5 for r in residuals)
        win = sum(r >= t + 0.5 if up else r < t - 0.5 for r in residuals)
        n = len(residuals) + 1.5
        return (win + 0.5) / n, (push + 0.5) / n, (len(residuals) - win - push + 0.5) / n
    win = sum(r > t if up else r < t for r in residuals)
    n = len(residuals) + 1.0
    return (win + 0.5) / n, 0.0, (len(residuals) - win + 0.5) / n


def test_lattice_probabilities(spark):
    rng = random.Random(2)
    left = {b: [rng.choice([-3.0, -0.5, 0.0, 0.5, 1.0, 2.25]) for _ in range(n)] for b, n in ((1, 7), (2, 40))}
    residuals = spark.createDataFrame([(b, r, 1) for b, rs in left.items() for r in rs], "block_ord int, r double, n int").groupBy("block_ord", "r").agg(F.sum("n").alias("n"))
    rows = [(k, rng.choice([1, 2, 3]), m, s, rng.choice([-2.0, 0.5, 1.25]), rng.choice([None, -1.5, 0.0, 2.0, 0.75])) for k in range(200) for m, s in [rng.choice([("spread", "home"), ("spread", "away"), ("total", "over"), ("total", "under")])]]
    got = {r.id: r for r in offers.lattice_probabilities(spark.createDataFrame(rows, "id int, block_ord int, market string, side string, predicted double, line double").repartition(3), residuals, ["block_ord"]).collect()}
    for k, b, market, side, predicted, line in rows:
        want = lattice(left[b], market, side, predicted, line) if b in left and line is not None else (None,) * 3
        assert (got[k].p_win, got[k].p_push, got[k].p_loss) == pytest.approx(want)


# resampling


def test_a_biased_model_is_unstable(spark):
    """A constant gap of 0.2 has a radius of 0.2 whatever is drawn; Appendix A calls it unstable."""
    rows = [(b, 0.2) for b in range(6) for _ in range(40)]
    got = {r.block_ord: r for r in fits.reliability_states(spark.createDataFrame(rows, "block_ord int, gap double")).collect()}
    assert (got[0].support, got[0].radius, got[0].stable) == (0, None, False)
    assert got[3].radius is None and got[3].support == 120
    assert got[5].radius == pytest.approx(0.2) and not got[5].stable and (got[5].support, got[5].n_blocks) == (200, 5)
    calm = fits.reliability_states(spark.createDataFrame([(b, 0.3 * (-1) ** k) for b in range(6) for k in range(40)], "block_ord int, gap double")).orderBy("block_ord").collect()
    assert calm[5].radius == pytest.approx(0, abs=1e-9) and calm[5].stable
    one = fits.reliability_states(spark.createDataFrame([(0, 0.01)] * 200 + [(1, 0.0)], "block_ord int, gap double")).orderBy("block_ord").collect()
    assert one[1].radius == 0.10 and not one[1].stable


def plain_draws(n, replicates, seed):
    return np.concatenate(list(bootstrap.block_draws(n, replicates, seed)))


def test_radius_repeats_its_draws(spark):
    rng = random.Random(5)
    rows = [(b, rng.gauss(0.02, 0.3)) for b in range(9) for _ in range(rng.randrange(15, 40))]
    got = {r.block_ord: r for r in fits.reliability_states(spark.createDataFrame(rows, "block_ord int, gap double").repartition(3), seed=4).collect()}
    per = [[g for b, g in rows if b == k] for k in range(9)]
    for target in range(9):
        n = sum(map(len, per[:target]))
        assert got[target].support == n
        if n < 128:
            continue
        values = sorted(abs(sum(sum(per[k]) for k in d) / sum(len(per[k]) for k in d)) for d in plain_draws(target, 1000, 4))
        assert got[target].radius == pytest.approx(values[round(999 * 0.9)])
        assert got[target].stable == (target >= 4 and got[target].radius <= 0.05)


def test_bootstrap_repeats_its_draws(spark):
    rows = [(b, float(b % 3), 1.0) for b in range(20)]
    df = spark.createDataFrame(rows, "b int, s double, n double")
    run = lambda d: ev.bootstrap(d, "b", F.sum("s") / F.sum("n"), replicates=300, seed=4).first()
    r = run(df)
    assert r == run(df.orderBy(F.rand(1)).repartition(3)) and r.low < r.estimate < r.high
    means = [np.mean([rows[k][1] for k in d]) for d in plain_draws(20, 300, 4)]
    assert (r.low, r.high, r.n_replicates) == pytest.approx((*np.percentile(means, [2.5, 97.5]), 300))


def test_bootstrap_difference_draws_blocks_in_each_period(spark):
    rows = [(k, "ab"[k % 2], float(k), 1 + k % 3) for k in range(10)]
    df = spark.createDataFrame(rows, "w int, half string, s double, n int")
    got = ev.bootstrap_difference(df, "w", "half", ("a", "b"), F.sum("s") / F.sum("n"), replicates=300, seed=5).first()
    of = lambda rs: sum(r[2] for r in rs) / sum(r[3] for r in rs)
    a, b = [r for r in rows if r[1] == "a"], [r for r in rows if r[1] == "b"]
    assert (got.value_a, got.value_b, got.difference) == pytest.approx((of(a), of(b), of(b) - of(a)))
    d = [of([b[x] for x in r]) - of([a[x] for x in r]) for r in plain_draws(5, 300, 5)]
    assert (got.low, got.high, got.n_replicates) == pytest.approx((np.percentile(d, 2.5), np.percentile(d, 97.5), 300))


def test_draws_are_uniform():
    n = 7
    counts = np.bincount(plain_draws(n, 20_000, 1).ravel(), minlength=n)
    assert ((counts - counts.mean()) ** 2 / counts.mean()).sum() < 22.5  # chi-squared of six degrees, one in a thousand


def test_poisson_weights():
    h = bootstrap.counters(3, np.arange(400), np.arange(1000)).ravel()
    w = bootstrap.poisson_weights(h)
    assert [int((w == k).sum()) / len(w) for k in range(6)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=3e-3)
    edges = np.array([0, 1, *(int(b) + d for b in bootstrap._BOUNDS[:12] for d in (-1, 0, 1))], np.uint64)
    assert bootstrap.poisson_weights(edges).tolist() == [sum(int(e) >= int(b) for b in bootstrap._BOUNDS) for e in edges]


def test_row_bootstrap_over_groups(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CELLS", 5000)
    rng = random.Random(9)
    rows = [(k, rng.choice(["u", "v", None]), rng.gauss(1, 2)) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, g string, x double").repartition(4)
    values = {"s": F.col("x"), "n": F.lit(1)}
    sums = {(r.g, r.rep): r for r in bootstrap.poisson_sums(df, ["k"], values, ["g"], 200, 2).collect()}
    assert len(sums) == 600
    keys = {r.k: r.h for r in df.select("k", F.xxhash64("k").alias("h")).collect()}
    w = bootstrap.poisson_weights(bootstrap.counters(2, np.arange(200), np.array([keys[k] for k, *_ in rows], np.int64).view(np.uint64)))
    for g in ("u", "v", None):
        own = np.array([r[1] == g for r in rows])
        x = np.array([r[2] for r in rows])
        for rep in (0, 7, 199):
            assert (sums[g, rep].s, sums[g, rep].n) == pytest.approx(((w[rep] * own) @ x, (w[rep] * own).sum()))
    r = {x.g: x for x in ev.bootstrap_rows(df, ["k"], values, F.sum("s") / F.sum("n"), replicates=2000, by=["g"]).collect()}
    for g in ("u", "v", None):
        own = [x[2] for x in rows if x[1] == g]
        assert r[g].estimate == pytest.approx(np.mean(own)) and r[g].se == pytest.approx(np.std(own) / len(own) ** 0.5, rel=0.1) and r[g].low < r[g].estimate < r[g].high
    whole = ev.bootstrap_rows(df, ["k"], values, F.sum("s") / F.sum("n"), replicates=500).first()
    assert whole.n_replicates == 500 and whole.low < whole.estimate < whole.high


# systems and rating states


def test_conjugate_gradients(spark):
    rng = np.random.default_rng(2)
    rows, right, want = [], [], {}
    for g, n in (("a", 12), ("b", 1), ("c", 5)):
        m = rng.normal(size=(n, n))
        m = m @ m.T + np.eye(n)
        v = rng.normal(size=n) if g != "c" else np.zeros(n)
        rows += [(g, f"t{i}", f"t{j}", float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]]
        right += [(g, f"t{i}", float(v[i])) for i in range(n)]
        want |= {(g, f"t{i}"): x for i, x in enumerate(np.linalg.solve(m, v))}
    got = linear.solved(spark.createDataFrame(rows, "g string, i string, j string, v double"), spark.createDataFrame(right, "g string, i string, v double"), ["g"])
    assert {(r.g, r.i): r.x for r in got.collect()} == pytest.approx(want, abs=1e-8)


LEAGUE = "league string, block_ord int, season int, game string, home string, away string, home_score int, away_score int, neutral boolean, post boolean, home_adjustment double, away_adjustment double"


def test_post_season_games_move_less_and_states_resume(spark):
    rng = random.Random(3)
    rows = []
    for b in range(60):
        teams = rng.sample("abcdefgh", 6 if b > 20 else 8)  # some sit out whole seasons
        rows += [("L", b, 2000 + b // 12, f"{b}-{k}", teams[2 * k], teams[2 * k + 1], rng.randrange(40) if b % 9 else None, rng.randrange(40), k == 0, b % 12 > 9, 1.0, 0.0) for k in range(len(teams) // 2)]
    config = {"x": Rating(), "y": Rating(carry_back=0.6, k_post=20.0)}
    df = spark.createDataFrame(rows, LEAGUE)
    whole = {(r.config, r.game, r.side): r for r in ratings.rating_ledger(df.repartition(3), config).collect()}
    r, season, c = {}, None, config["x"]
    for _, b, s, game, h, a, hs, as_, neutral, post, *_ in rows:
        if season is not None and s != season:
            r = {k: v + c.carry_back * (1500 - v) for k, v in r.items()}
        season = s
        x, y = r.get(h, 1500.0), r.get(a, 1500.0)
        p = 1 / (1 + 10 ** (-(x + (0 if neutral else 48) - y) / 400))
        d = 0.0 if hs is None else (4 if post else 20) * min(2.5, 1 + (abs(hs - as_) / 6) ** 2) * ((hs > as_) + 0.5 * (hs == as_) - p)
        assert (whole["x", game, "home"].before, whole["x", game, "home"].change) == pytest.approx((x, d))
        r[h], r[a] = x + d, y - d
    for cut in (20, 24, 36, 59):
        early = ratings.rating_ledger(df.where(F.col("block_ord") < cut), config)
        state = ratings.rating_state(early, config)
        later = ratings.rating_ledger(df.where(F.col("block_ord") >= cut), config, state).collect()
        assert len(later) == sum(2 for x in rows if x[1] >= cut) * 2
        for x in later:
            assert (x.before, x.after) == pytest.approx((whole[x.config, x.game, x.side].before, whole[x.config, x.game, x.side].after))
