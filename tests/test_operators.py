"""Operators on small rows with results worked by hand, against numpy, and under poisoned or shuffled input."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import functions as fn
from tidemark import quality
from tidemark.functions import Rating
from tidemark.models import fits, ratings
from tidemark.operators import asof, blocks, events, history, identity, offers, reshape, snapshots
from tidemark.operators import evaluation as ev


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# scalar functions


def test_prices(spark):
    r = one(spark, fn.american_to_decimal(F.lit(150)), fn.american_to_decimal(F.lit(-200)), fn.american_to_decimal(F.lit(0)), fn.decimal_to_american(F.lit(2.5)), fn.decimal_to_american(F.lit(1.5)), fn.decimal_to_american(F.lit(1.0)), fn.conservative_american(F.lit(1.505)))
    assert list(r)[:2] == pytest.approx([2.5, 1.5]) and list(r)[2:6] == [None, 150, -200, None] and r[6] == -198


def test_normal_functions(spark):
    z = [-8.0, -2.5, -1e-3, 0.0, 0.7, 4.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(fn.normal_cdf("z")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / 2**0.5)) for x in z], abs=1e-7)
    p = [1e-6, 0.01, 0.02425, 0.5, 0.9, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(fn.normal_inverse("p")).collect()]
    assert [0.5 * (1 + math.erf(x / 2**0.5)) for x in got] == pytest.approx(p, rel=1e-6)
    assert list(one(spark, fn.normal_inverse(F.lit(0.0)), fn.normal_inverse(F.lit(1.0)))) == [None, None]


def test_implied_mean_inverts_the_probability(spark):
    r = one(spark, fn.above_probability(fn.implied_mean(F.lit(44.5), F.lit(0.63), F.lit(13.0)), F.lit(44.5), F.lit(13.0)), fn.implied_mean(F.lit(44.0), F.lit(0.63), F.lit(13.0)))
    assert r[0] == pytest.approx(0.63, abs=1e-6) and r[1] is None
    line, p = np.array([44.0, 44.5, -3.0]), np.array([0.63, 0.4, 0.5])
    mean = fits.implied_means(line, p, 13.0)
    cdf = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / 2**0.5)))
    win, loss = 1 - cdf((line + [0.5, 0, 0.5] - mean) / 13), cdf((line - [0.5, 0, 0.5] - mean) / 13)
    assert win / (win + loss) == pytest.approx(p, abs=1e-9)


def test_rating_numbers(spark):
    r = one(spark, *(fn.margin_multiplier(F.lit(m)) for m in (0, 3, 7, 10, -7)), fn.home_probability(F.lit(1500.0), F.lit(1500.0), 48.0))
    assert list(r) == pytest.approx([1.0, 1.25, 2.361111, 2.5, 2.361111, 0.568641], abs=1e-6)


def test_settlement(spark):
    s = lambda *a: fn.settlement(*(F.lit(x) for x in a))
    r = one(spark, s("spread", "home", -3.0, 24, 21), s("spread", "home", -2.5, 24, 21), s("spread", "away", 2.5, 24, 21), s("total", "over", 45.0, 24, 21), s("total", "under", 45.5, 24, 21), s("moneyline", "away", None, 24, 24), s("moneyline", "draw", None, 1, 2), s("spread", "home", -3.0, None, 2))
    assert list(r) == ["PUSH", "WIN", "LOSS", "PUSH", "WIN", "PUSH", None, None]


def test_empirical_probabilities(spark):
    res = spark.createDataFrame([(0, x) for x in (-1, 0, 1)], "block_ord int, residual int")
    o = spark.createDataFrame([(1, "spread", "home", -3.0, 3.0), (1, "spread", "home", -2.5, 3.0), (0, "spread", "home", -3.0, 3.0)], "block_ord int, market string, side string, line double, predicted double")
    got = sorted((r.block_ord, r.line, r.p_win, r.p_push, r.p_loss) for r in offers.residual_probabilities(o, res).collect())
    assert got[0][2:] == (None, None, None)
    assert got[1][2:] == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    assert got[2][2:] == pytest.approx((2.5 / 4, 0.0, 1.5 / 4))


def test_reliability_tiers(spark):
    t = lambda *a: fn.reliability_tier(*(F.lit(x) for x in a))
    r = one(spark, t(600, 0.02, 0.0, 0.05, True), t(600, 0.04, 0.0, 0.05, True), t(600, None, 0.0, 0.0, True), t(600, 0.02, 0.2, 0.0, True), t(10, 0.02, 0.0, 0.0, True), t(600, 0.02, 0.0, 0.05, False), fn.uncertainty_factor(F.lit(None).cast("double")), fn.uncertainty_factor(F.lit(0.05)))
    assert list(r) == ["HIGH", "MEDIUM", "LOW", "UNSUPPORTED", "LOW", "LOW", 0.0, 0.5]


def test_play_through(spark):
    a = lambda ok, ev_, p, be, tier: fn.play_through(F.lit(ok), F.lit(ev_).cast("double"), F.lit(p), F.lit(be), F.lit(tier), F.lit(0.0))["status"]
    assert list(one(spark, a(True, 0.1, 0.5, 0.45, "HIGH"), a(True, -0.01, 0.5, 0.51, "HIGH"), a(True, -0.1, 0.5, 0.55, "HIGH"), a(True, None, 0.5, 0.5, "HIGH"), a(False, 0.1, 0.5, 0.4, "HIGH"))) == ["VALUE", "PLAYABLE", "LEAN", "PASS", "UNSUPPORTED"]


@pytest.mark.parametrize("day, after, before", [("2024-09-05", "2024-09-10", "2024-09-03"), ("2024-09-10", "2024-09-17", "2024-09-03"), ("2024-09-11", "2024-09-17", "2024-09-10"), ("2025-01-21", "2025-01-28", "2025-01-14"), ("2025-01-13", "2025-01-14", "2025-01-07")])
def test_boundaries(spark, day, after, before):
    d = F.lit(day).cast("date")
    assert [str(x) for x in one(spark, fn.boundary_after(d).cast("string"), fn.boundary_before(d).cast("string"))] == [f"{after} 12:00:00", f"{before} 12:00:00"]


def test_zones_and_strict_timestamps(spark):
    r = one(spark, fn.local_to_utc(F.lit("2024-01-05"), F.lit("13:00")).cast("string"), fn.local_to_utc(F.lit("2024-07-05"), F.lit("9:30")).cast("string"), fn.local_to_utc(F.lit("2024-07-05"), F.lit("x")), fn.strict_timestamp(F.lit("2024-01-05T10:00:00Z")).cast("string"), fn.strict_timestamp(F.lit("2024-01-05T10:00:00+0200")).cast("string"), fn.strict_timestamp(F.lit("2024-01-05T10:00:00")))
    assert list(r) == ["2024-01-05 18:00:00", "2024-07-05 13:30:00", None, "2024-01-05 10:00:00", "2024-01-05 08:00:00", None]


def test_text(spark):
    r = one(spark, fn.name_key(F.lit("  José  O'Neill Jr.")), fn.same_name(F.lit("JOSE"), F.lit("José")), fn.to_long(F.lit("3.9")), fn.to_long(F.lit("NaN")), fn.to_double(F.lit("inf")), fn.to_boolean(F.lit("No")), fn.to_string(F.lit("  ")), fn.block_label(F.lit(2024), F.lit(3)), fn.id_part(F.lit("a_b"), 5))
    assert list(r) == ["jose o neill", True, 3, None, None, False, None, "2024-W03", None]


def test_strict_recode_fails_on_unknown_values(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r[0] for r in df.select(fn.strict_recode("v", {"a": 1}, 0)).collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown value: b"):
        spark.createDataFrame([("b",)], "v string").select(fn.strict_recode("v", {"a": 1})).collect()


def test_periods_and_stages(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "q int")
    assert [r[0] for r in df.select(fn.half_of_period("q")).collect()] == [1, 1, 2, 2, 3, None]
    with pytest.raises(Exception, match="unknown period"):
        spark.createDataFrame([(6,)], "q int").select(fn.half_of_period("q")).collect()
    assert one(spark, fn.stage_rank(F.lit("DIV"), ["REG", "WC", "DIV"]))[0] == 2


def test_freshness(spark):
    now, old = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    f = lambda ok, last, present, n: fn.freshness_state(F.lit(ok), last, F.array(*map(F.lit, present)) if present else F.array().cast("array<string>"), ["a"], F.lit(n), now, 3600.0)
    assert list(one(spark, f(False, old, ["a"], 1), f(True, now, [], 1), f(True, now, ["b"], 1), f(True, old, ["a"], 1), f(True, now, ["a", "b"], 1), f(True, now, ["a"], 0))) == ["FETCH_FAILED_USING_NO_FALLBACK", "INCOMPLETE_RESPONSE", "SCHEMA_DRIFT", "STALE_LAST_SUCCESS", "FRESH_FETCH_CHANGED", "FRESH_FETCH_NO_CHANGE"]


# point in time


def _facts(seed, n=400):
    rng = random.Random(seed)
    return [(f"e{rng.randrange(8)}", k, 2000 + rng.randrange(3), rng.randrange(60), float(rng.randrange(100)) if rng.random() > 0.1 else None) for k in range(n)]


def test_asof_equals_brute_force_and_equality_counts(spark):
    facts, targets = _facts(1), [(f"e{k % 9}", k, k % 61) for k in range(200)] + [(None, 900, 5), ("e1", 901, None)]
    f = spark.createDataFrame(facts, "e string, k int, season int, t int, v double")
    t = spark.createDataFrame(targets, "e string, id int, cut int")
    got = {r.id: r.k for r in asof.asof(t, f, ["e"], "cut", "t", ["k"], ["k"]).collect()}
    for e, i, cut in targets:
        seen = [(x[3], x[1]) for x in facts if x[0] == e and cut is not None and x[3] <= cut]
        assert got[i] == (max(seen)[1] if seen else None)


def test_future_facts_do_not_move_the_past(spark):
    facts = _facts(2)
    poisoned = [x if x[3] <= 30 else (*x[:4], 1e9) for x in facts]
    t = spark.createDataFrame([(f"e{k}", k, 30) for k in range(8)], "e string, id int, cut int")

    def run(rows):
        f = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "e string, k int, season int, t int, v double").repartition(3)
        r = asof.rolled(f, ["e"], ["t", "k"], ["v"], [4])
        return sorted(map(tuple, asof.asof(t, r, ["e"], "cut", "t", ["roll4_v_mean", "roll4_v_n", "roll4_v_std"], ["k"]).collect()))

    assert run(facts) == run(poisoned)


def test_entering_state_hides_the_block(spark):
    u = spark.createDataFrame([("a", 1, 2.0, 1.0, 1), ("a", 1, 3.0, 1.0, 1), ("a", 3, 10.0, 2.0, 1)], "e string, block_ord int, num double, den double, n long")
    assert sorted(map(tuple, history.entering_state(u, ["e"]).collect())) == [("a", 1, 0.0, 0.0, 0), ("a", 3, 5.0, 2.0, 2)]


def test_shrinkage_golden(spark):
    x = (0.09375 * 30 + (1 / 26) * 25) / 55
    assert one(spark, history.shrunk(F.lit(x), F.lit(58), -0.05, 250.0))[0] == pytest.approx(-0.027663, abs=1e-6)
    assert one(spark, history.shrunk(F.lit(None).cast("double"), F.lit(58), -0.05, 250.0))[0] == -0.05


def test_anchored_clusters_measure_from_the_start(spark):
    base = dt.datetime(2024, 1, 1, 13)
    rows = [(1, base + dt.timedelta(minutes=m), m) for m in (0, 20, 31, 40, 61, 62, 93)]
    got = blocks.anchored_clusters(spark.createDataFrame(rows, "d int, t timestamp, id int"), ["d"], "t", 30, "id").collect()
    assert sorted(list(r.ids) for r in got) == [[0, 20], [31, 40, 61], [62], [93]]


def test_intervals(spark):
    rows = [(1, k, q, None if t is None else float(t)) for k, (q, t) in enumerate([(1, 900), (1, 780), (1, 780), (1, 659), (2, 640), (2, None), (2, 600)])]
    got = events.intervals(spark.createDataFrame(rows, "g int, k int, q int, t double"), ["g"], ["k"], "t", ["q"]).orderBy("k").collect()
    assert [r.valid_interval for r in got] == [False, True, False, False, False, False, False]
    assert [r.seconds for r in got] == [None, 120.0, 0.0, 121.0, 19.0, None, None]


PLAY = {"game": 1, "play_id": 1, "drive": 1, "posteam": "a", "defteam": "b", "play_type": "run", "play_deleted": 0.0, "aborted_play": 0.0, "pass_attempt": 0.0, "rush_attempt": 0.0, "complete_pass": 0.0, "qb_dropback": None, "qb_kneel": 0.0, "qb_spike": 0.0, "sack": 0.0, "epa": 0.5, "success": 1.0, "interception": 0.0, "fumble_lost": 0.0, "qtr": 1, "score_differential": 0.0, "game_seconds_remaining": 1800.0, "yardline_100": 50.0, "goal_to_go": 0.0, "yards_gained": 5.0, "result": None}
PLAY_SCHEMA = ", ".join(f"{k} {'string' if k in ('posteam', 'defteam', 'play_type', 'result') else 'int' if k in ('game', 'play_id', 'drive', 'qtr') else 'double'}" for k in PLAY)


def _plays(spark, *changes):
    return spark.createDataFrame([tuple((PLAY | {"play_id": k} | c).values()) for k, c in enumerate(changes)], PLAY_SCHEMA)


def test_play_flags(spark):
    df = events.play_flags(_plays(spark, {"rush_attempt": 1.0, "qb_kneel": 1.0}, {"sack": 1.0}, {"interception": 1.0, "fumble_lost": 1.0}, {"rush_attempt": 1.0, "epa": None}, {"rush_attempt": 1.0, "score_differential": -8.0}, {"rush_attempt": 1.0, "score_differential": 9.0}, {"rush_attempt": 1.0, "qtr": 4, "game_seconds_remaining": 899.0}, {"rush_attempt": 1.0, "qtr": 4, "game_seconds_remaining": 900.0}, {"posteam": None, "rush_attempt": 1.0}, {"rush_attempt": 1.0, "score_differential": None}))
    r = df.orderBy("play_id").collect()
    assert not r[0].is_rush and r[1].is_dropback and r[2].is_turnover and not r[3].has_epa
    # the fourth quarter is never neutral
    assert [x.is_neutral for x in r[4:8]] == [True, False, False, False] and not r[8].is_valid and not r[9].is_neutral
    assert all(v is not None for x in r for k, v in x.asDict().items() if k.startswith(("is_", "has_", "in_")))


def test_valid_plays_turnovers_and_explosive_passes(spark):
    changes = [{"defteam": None}, {"play_type": "punt"}, {"play_type": None}, {"play_deleted": None}, {"aborted_play": 1.0}, {"play_type": "qb_spike"}, {"interception": 1.0}, {"pass_attempt": 1.0, "interception": 1.0}, {"pass_attempt": 1.0, "yards_gained": 25.0}, {"pass_attempt": 1.0, "qb_dropback": 0.0}]
    r = events.play_flags(_plays(spark, *changes)).orderBy("play_id").collect()
    assert [x.is_valid for x in r] == [False] * 5 + [True] * 5
    assert [x.is_turnover for x in r[6:8]] == [False, True] and r[8].is_explosive_pass and not r[8].is_completion
    assert r[8].is_dropback and r[8].is_dropback_fallback and not r[9].is_dropback and not r[9].is_dropback_fallback


def test_possessions(spark):
    p = _plays(spark, {"drive": 1}, {"drive": 1, "result": "Touchdown"}, {"drive": 2, "result": "Field goal"}, {"drive": 2, "result": "Punt"}, {"drive": 3})
    got = {r.drive: r for r in events.possessions(p, ["game", "drive"], "play_id", "result", {"n_pass": F.col("pass_attempt") == 1}).collect()}
    assert (got[1].result, got[1].points, got[1].scored) == ("Touchdown", 7, True) and got[2].n_results == 2 and got[3].points is None
    with pytest.raises(Exception, match="unknown value"):
        events.possessions(_plays(spark, {"result": "?"}), ["game"], "play_id", "result", {}).collect()


# evaluation


@pytest.mark.parametrize("p, y, want", [([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0), ([0.9, 0.1], [0, 1], 0.0), ([0.5] * 4, [0, 1, 0, 1], 0.5), ([0.1, 0.2], [1, 1], None)])
def test_auc(spark, p, y, want):
    assert ev.auc(spark.createDataFrame(list(zip(p, y, strict=True)), "p double, y int"), "p", "y").first().auc == want


def test_reliability_bins_hold_the_edges(spark):
    t = ev.reliability_table(spark.createDataFrame([(0.0, 0), (0.1, 1), (0.9, 1), (1.0, 1)], "p double, y int"), "p", "y").orderBy("bin").collect()
    assert [r.n for r in t] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]


def test_regression_scores_equal_numpy(spark):
    rng = np.random.default_rng(1)
    p, a = rng.integers(0, 9, 200).astype(float), rng.integers(0, 9, 200).astype(float)
    df = spark.createDataFrame([(float(x), float(z), k % 5) for k, (x, z) in enumerate(zip(p, a, strict=True))], "p double, a double, b int")
    r = ev.regression_scores(df, "p", "a", "b").first()
    import pandas as pd

    assert (r.rmse, r.pearson) == pytest.approx((np.sqrt(((p - a) ** 2).mean()), np.corrcoef(p, a)[0, 1]))
    assert r.spearman == pytest.approx(pd.Series(p).rank().corr(pd.Series(a).rank()))


# identity and snapshots


def test_crosswalk_conflicts_end_the_search(spark):
    rows = spark.createDataFrame([(1, "x", "q"), (2, None, "q"), (3, "dup", "q"), (4, None, None)], "id int, a string, b string")
    ref = spark.createDataFrame([(10, "x", None), (11, None, "q"), (12, "dup", None), (13, "dup", None)], "target int, ra string, rb string")
    got = {r.id: (r.target, r.method, r.status) for r in identity.crosswalk(rows, ref, "id", "target", [("one", "a", "ra"), ("two", "b", "rb")]).collect()}
    assert got == {1: (10, "one", "MATCHED"), 2: (11, "two", "MATCHED"), 3: (None, "one", "CONFLICT"), 4: (None, None, "UNMATCHED")}


def test_changes(spark):
    schema = "id int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, "z", 3)], schema)
    new = spark.createDataFrame([(1, "y", 1), (2, "p", None), (4, "n", 4)], schema)
    got = sorted((r.id, r.field or "", r.change_type) for r in snapshots.changes(old, new, "id", ["a", "b"]).collect())
    assert got == [(1, "a", "changed"), (2, "a", "populated"), (2, "b", "cleared"), (3, "", "dropped"), (4, "", "first_seen")]
    assert snapshots.changes(old, new, "id", ["a"], first=True).where("change_type <> 'first_seen'").count() == 0


def test_overrides_must_be_exact(spark):
    rows = spark.createDataFrame([(1, "A", None), (2, "B", "g2")], "id int, s string, game string")
    good, gates = identity.overridden(rows, spark.createDataFrame([(1, "g1")], "id int, game string"), ["id"], "game", F.col("game").isNull())
    assert sorted(r.game for r in good.collect()) == ["g1", "g2"] and gates.count() == 0
    _, gates = identity.overridden(rows, spark.createDataFrame([(2, "g1")], "id int, game string"), ["id"], "game", F.col("game").isNull())
    assert gates.count() == 2


def test_scenarios(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "id int, candidates array<string>")
    got = sorted((r.id, r.candidate or "", r.scenario_rank) for r in reshape.scenarios(df, "candidates").collect())
    assert got == [(1, "a", 1), (1, "b", 2), (2, "", None), (3, "", None)]


# gates


def test_gates_find_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "h", 1.0), (1, "a", -1.0), (2, "h", 2.0), (2, "h", float("nan")), (None, "a", 0.0)], "g int, side string, x double")
    assert quality.unique_key(df, ["g"]).count() == 3
    assert quality.pairs(df, ["g"], "side", ("h", "a"), "x").count() == 2
    assert quality.finite(df, ["x", "side"]).count() == 2
    assert quality.in_window(df, "g", 1, 1).first().n == 3
    assert quality.forbidden_columns(df, ["side"], ["x"]).count() == 2
    assert quality.expected_counts(df.where("g is not null"), "g", {1: 2, 2: 3}).count() == 1
    assert quality.schema_matches(df, T.StructType([T.StructField("g", T.IntegerType())])).count() == 2
    with pytest.raises(quality.QualityError):
        quality.assert_clean(quality.unique_key(df, ["g"]))
    quality.assert_clean(quality.unique_key(df.where("side = 'a'"), ["g", "side", "x"]).where("detail not like 'null%'"))
    with pytest.raises(Exception, match="sealed"):
        quality.sealed(df.where("g is not null"), "g", 1).collect()


def test_fingerprint_ignores_order_and_sees_values(spark):
    rows = [(k, float(k) / 3, None if k % 4 else "x") for k in range(100)]
    f = lambda r: tuple(quality.fingerprint(spark.createDataFrame(r, "a int, b double, c string").repartition(3)).first())
    assert f(rows) == f(rows[::-1]) != f([*rows[:-1], (99, 33.0, "y")])


def test_ledgers_equal(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x")], "k int, v double, s string")
    assert quality.equal_ledgers(a, a, ["k"]).count() == 0
    b = spark.createDataFrame([(1, 1.0, "y"), (3, 2.0, "x")], "k int, v double, s string")
    assert {r.detail for r in quality.equal_ledgers(a, b, ["k"]).collect()} == {"key on one side", "column s"}


# fits


def _league(n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for b in range(n):
        teams = rng.sample("abcdefgh", 8)
        rows += [("L", b, 2000 + b // 40, f"{b}-{k}", teams[2 * k], teams[2 * k + 1], rng.randrange(40) if b < n - 2 else None, rng.randrange(40) if b < n - 2 else None, k == 0, 0.0, 0.0) for k in range(4)]
    return rows


LEAGUE = "league string, block_ord int, season int, game string, home string, away string, home_score int, away_score int, neutral boolean, home_adjustment double, away_adjustment double"


def test_rating_fold_equals_a_plain_loop(spark):
    rows, c = _league(), Rating()
    got = {(r.game, r.side): r for r in ratings.rating_ledger(spark.createDataFrame(rows, LEAGUE).repartition(4), {"x": c}).collect()}
    r, season = {}, None
    for _, b, s, game, h, a, hs, as_, neutral, *_ in rows:
        if season is not None and s != season:
            r = {k: v + c.carry_back * (c.start - v) for k, v in r.items()}
        season = s
        x, y = r.get(h, c.start), r.get(a, c.start)
        p = 1 / (1 + 10 ** (-(x + (0 if neutral else c.home) - y) / c.scale))
        d = 0.0 if hs is None else c.k * min(c.margin_cap, 1 + (abs(hs - as_) / c.margin_divisor) ** 2) * ((hs > as_) + 0.5 * (hs == as_) - p)
        assert (got[game, "home"].before, got[game, "home"].p, got[game, "away"].change) == pytest.approx((x, p, -d))
        r[h], r[a] = x + d, y - d
    assert ratings.replay_differences(spark.createDataFrame(list(got.values())), spark.createDataFrame(rows, LEAGUE), {"x": c}).count() == 0


def test_logistic_statuses():
    x, y = np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1])
    a, b, status = fits.logistic(x, y)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert status == "CONVERGED" and (p - y).sum() == pytest.approx(0, abs=1e-8) and ((p - y) * x).sum() == pytest.approx(0, abs=1e-8)
    assert [fits.logistic(np.array(u), np.array(v))[2] for u, v in (([1.0], [1.0]), ([1.0, 2.0], [1.0, 1.0]), ([1.0, 1.0], [0.0, 1.0]), ([0.0, 1.0], [0.0, 1.0]))] == ["TOO_FEW", "SINGLE_CLASS", "CONSTANT", "DIVERGED"]


def test_pooling_uses_earlier_blocks_only(spark):
    rng = np.random.default_rng(5)
    rows = [(b, float(q), float(np.clip(q + rng.normal(0, 0.1), 0.02, 0.98)), int(rng.random() < q)) for b in range(6) for q in rng.uniform(0.1, 0.9, 60)]
    pairs = blocks.prior_pairs(spark.createDataFrame([(b,) for b in range(6)], "block_ord int"))
    run = lambda r: {x.target: x for x in fits.pooling(spark.createDataFrame(r, "block_ord int, m double, k double, y int"), pairs, "m", "k", "y").collect()}
    a, b = run(rows), run([r if r[0] < 3 else (*r[:3], 1 - r[3]) for r in rows])
    assert a[3] == b[3] and a[1].reason == "TOO_FEW" and a[5].supported and 0 <= a[5].weight <= 1 and a[5] != b[5]


def test_best_offer_prefers_the_number_then_price_then_book(spark):
    rows = [("spread", "home", 3.5, -115, "z"), ("spread", "home", 3.0, 100, "a"), ("total", "over", 44.0, -110, "b"), ("total", "over", 43.5, -120, "a"), ("moneyline", "home", None, 120, "a"), ("moneyline", "home", None, 120, "k")]
    got = {(r.market, r.side): (r.line, r.price, r.book) for r in offers.best_offers(spark.createDataFrame(rows, "market string, side string, line double, price int, book string"), ["market", "side"], ["k"]).collect()}
    assert got == {("spread", "home"): (3.5, -115, "z"), ("total", "over"): (43.5, -120, "a"), ("moneyline", "home"): (None, 120, "k")}


def test_every_customer_of_orders_is_classed(spark, sf_dir):
    from tidemark.plans import QUERIES

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = QUERIES["candidate_classes"](spark, sf_dir).collect()
    assert {r.o_custkey for r in rows} == {r.o_custkey for r in orders.select("o_custkey").distinct().collect()}
    assert sum(r.n_candidates for r in rows) == orders.count()


def test_request_plan_covers_every_order_within_its_span(spark, sf_dir):
    from tidemark.plans import QUERIES

    rows = QUERIES["request_plan_rows"](spark, sf_dir).collect()
    games = [int(g) for r in rows for g in r.games.split(",")]
    assert sorted(games) == sorted(r.o_orderkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").collect())
    assert all(r.cluster_start - r.requested_at == 3_600_000_000 and r.n == len(r.games.split(",")) for r in rows)


def test_ridge_panel_equals_the_plain_fit(spark):
    """Medians of the training rows for nulls, standardised numbers, one-hot categories, a ridge around the mean."""
    rng = np.random.default_rng(3)
    rows = [(b, k, float(rng.normal()) if rng.random() > 0.2 else None, float(k % 7), rng.choice(["p", "q", "r"]) if rng.random() > 0.1 else None, float(rng.normal() + 2 * (k % 7)) if k % 9 else None) for k, b in enumerate(b for b in range(6) for _ in range(40))]
    rows.append((5, 999, 0.5, None, "new", 1.0))
    df = spark.createDataFrame(rows, "block_ord int, k int, x1 double, x2 double, c string, y double")
    pairs = blocks.prior_pairs(df.select("block_ord").distinct())
    got = {(r.target, r.alpha, r.k): r.predicted for r in fits.ridge_panel(df, pairs, ["x1", "x2"], ["c"], "y", [1.0, 50.0], ["k"]).collect()}
    assert len(got) == 2 * len(rows)
    for target in range(6):
        train, test = [r for r in rows if r[0] < target and r[5] is not None], [r for r in rows if r[0] == target]
        for alpha in (1.0, 50.0):
            if len(train) < 50:
                assert all(got[target, alpha, r[1]] is None for r in test)
                continue
            mid = [float(np.median([r[c] for r in train if r[c] is not None])) for c in (2, 3)]
            number = lambda rs: np.array([[m if r[c] is None else r[c] for c, m in zip((2, 3), mid, strict=True)] for r in rs])
            a, b = number(train), number(test)
            mean, dev = a.mean(0), a.std(0)
            levels = sorted({r[4] for r in train if r[4] is not None})
            hot = lambda rs: np.array([[float(r[4] == x) for x in levels] for r in rs])
            a, b = np.hstack([(a - mean) / dev, hot(train)]), np.hstack([(b - mean) / dev, hot(test)])
            y = np.array([r[5] for r in train])
            centre, base = a.mean(0), y.mean()
            w = np.linalg.solve((a - centre).T @ (a - centre) + alpha * np.eye(a.shape[1]), (a - centre).T @ (y - base))
            assert [got[target, alpha, r[1]] for r in test] == pytest.approx((b - centre) @ w + base, abs=1e-6)


def test_boosted_panel_walks_forward(spark):
    rng = np.random.default_rng(1)
    rows = [(b, k, float(rng.normal()), int(rng.random() < 0.5) if b != 9 else None) for k, b in enumerate(b for b in range(10) for _ in range(25))]
    of = lambda rs: {r.k: r for r in fits.boosted_panel(spark.createDataFrame(rs, "block_ord int, k int, x double, y int"), ["x"], "y", most_rounds=3).collect()}
    got = of(rows)
    assert len(got) == len(rows) and {r.status for r in got.values() if r.block_ord < 4} == {"WARMUP"} and {r.status for r in got.values() if r.block_ord >= 4} == {"FITTED"}
    again = of([r if r[0] < 8 else (*r[:2], r[2], None) for r in rows])  # later results change nothing before them
    assert all(got[r[1]].p_boosted == again[r[1]].p_boosted for r in rows if r[0] <= 8)
