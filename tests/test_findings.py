"""What the findings of round 3 found, on small tables."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import Rating
from tidemark.models import fits
from tidemark.operators import asof, blocks
from tidemark.plans import landing_queries, pipelines
from tidemark.streaming import jobs


def test_board_of_ranks_equals_a_scan_of_all_candidates():
    rng, board, ranks = random.Random(1), asof._Board(), {}
    for _ in range(4000):
        c, r = f"c{rng.randrange(40)}", rng.choice([None, *range(6)])
        board.put(c, r)
        ranks[c] = r
        if rng.random() < 0.4:
            known = {x: y for x, y in ranks.items() if y is not None}
            assert board.leaders() == (sorted(x for x, y in known.items() if y == min(known.values())) or None)
        assert len(board.heap) <= 2 * len(board.held) + 65


def test_closing_facts_equal_the_last_rows_of_whole_timelines(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([10, 20, 30, 40]), k, rng.choice([None, *range(9)])) for k in range(300)]
    facts = spark.createDataFrame(rows, "e string, s int, t int, k int, v long")
    whole = asof.season_to_date(asof.rolled(facts, ["e"], ["t", "k"], ["v"], [2, 4]), ["e"], "s", ["t", "k"], ["v"])
    want = asof.first_per_key(whole, ["e", "t"], [F.col("k").desc()])
    got = asof.closing(facts, ["e"], "s", "t", ["k"], ["v"], [2, 4])
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_edges_of_two_sides_are_opposite_to_the_last_bit(spark):
    quotes = [(g, "b0", "moneyline", s, 0.0, p) for g in range(60) for s, p in (("home", 100 + 7 * g), ("away", -101 - 5 * g))]
    q = spark.createDataFrame(quotes, "game long, book string, market string, side string, line double, price long")
    models = spark.createDataFrame([(g, "a", (g % 89 + 5) / 100) for g in range(60)], "game long, model string, p_home double")
    points = spark.createDataFrame([], "game long, margin double, total double")
    rows = pipelines.census_families(models, points, q, "b0", "b1", ["b2"]).where("family = 'TWO_SIDED'").collect()
    edges = {(r.game, r.side): r.edge for r in rows}
    assert len(edges) == 120 and all(edges[g, "home"] == -edges[g, "away"] for g in range(60))


def test_point_fits_never_gather_a_targets_rows(spark):
    rows = [(b, float(k % 7), k % 2 / 2, 0.3 + k % 5 / 10, float(k * 7 % 13)) for b in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "block_ord int, m double, t double, p double, a double")
    prior = blocks.prior_nodes(df.select("block_ord").distinct())
    states, residuals = fits.point_states(df, prior, "m", "t", "p", "a")
    plan = residuals._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Python" not in plan
    pairs = blocks.prior_pairs(df.select("block_ord").distinct())
    other, left = fits.point_states(df, pairs, "m", "t", "p", "a")
    near = lambda d: [[round(x, 9) if isinstance(x, float) else x for x in r] for r in sorted(d.collect())]
    assert near(states) == near(other) and near(residuals) == near(left)
    assert {r.target: r.n for r in states.collect()} == {1: 200, 2: 400}
    assert {r.target: r.s for r in residuals.groupBy("target").agg({"n": "sum"}).toDF("target", "s").collect()} == {1: 200, 2: 400}


class State:
    exists, kept = False, None

    @property
    def get(self):
        return self.kept

    def update(self, value):
        self.exists, self.kept = True, value


def test_keys_of_a_share_go_on_from_their_state():
    at = lambda k: pd.Timestamp("2024-01-01") + pd.Timedelta(k, "us")
    frame = lambda rows: pd.DataFrame(rows, columns=["key", "at", "a"])
    fold, state = jobs._changed(["a"]), State()
    first = list(fold((0,), iter([frame([("p", at(3), "y"), ("p", at(1), "x")]), frame([(None, at(1), None), ("p", at(3), "again")])]), state))
    assert sorted(map(repr, first[0].itertuples(index=False, name=None))) == sorted(map(repr, [("p", at(1), None, None, None, "first_seen"), (None, at(1), None, None, None, "first_seen"), ("p", at(3), "a", "x", "y", "changed")]))
    then = list(fold((0,), iter([frame([("p", at(2), "late"), ("p", at(4), None), (None, at(2), "z"), ("p", at(5), None)])]), state))
    assert list(then[0].itertuples(index=False, name=None)) == [(None, at(2), "a", None, "z", "populated"), ("p", at(4), "a", "y", None, "cleared")]
    assert list(fold((0,), iter([frame([("p", at(4), "late")])]), state)) == []


def test_leagues_of_a_share_go_on_from_their_state():
    columns = ["league", "block_ord", "game", "home", "away", "home_score", "away_score", "season", "neutral", "post", "home_adjustment", "away_adjustment"]
    rng = random.Random(3)
    rows = [(x, b, f"{b}", *rng.sample("abcd", 2), float(rng.randrange(30)), float("nan") if b == 5 else 7.0, b // 4, False, b == 3, 0.0, 1.0) for b in range(12) for x in (None, "x", "y")]
    frame = lambda some: pd.DataFrame(some, columns=columns)
    fold = jobs._rated(Rating())
    given = lambda out: sorted(map(repr, (r for d in out for r in d.itertuples(index=False, name=None))))
    whole = given(fold((0,), iter([frame(rows)]), State()))
    state = State()
    assert given([*fold((0,), iter([frame(rows[:15])]), state), *fold((0,), iter([frame(rows[15:])]), state)]) == whole and len(whole) == 36


def test_snapshots_are_packed_and_quotes_leave_them_once(spark, sf_dir):
    import json
    from pathlib import Path

    path = landing_queries._snapshots(spark, sf_dir)
    files = [f for f in Path(path.removeprefix("file:")).iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".lz4") for f in files)
    text = spark.read.text(path).first()[0]
    assert all(len(d["data"]) == 1 and d["timestamp"].endswith("T12:00:00Z") for d in json.loads(text))
    for table in landing_queries._canonical(spark, sf_dir)[:2]:
        assert "Scan json" not in table._jdf.queryExecution().executedPlan().toString()


def test_sides_of_a_guarded_join_keep_their_parts(spark):
    from tidemark.operators import identity

    a, b = (spark.range(100).select(F.col("id").alias("k"), (F.col("id") * m).alias(f"v{m}")) for m in (2, 3))
    rows, gates = identity.guarded_join(a, b, ["k"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")
    assert rows.count() == 100 and gates.count() == 0
    assert {r.gate for r in identity.guarded_join(a.union(a.limit(1)), b.where("k > 3"), ["k"])[1].collect()} == {"one_to_one:left", "one_to_one"}


def test_sets_of_parameters_share_a_pass_over_the_games(spark, monkeypatch):
    from tidemark.models import ratings

    rng = random.Random(4)
    rows = [(x, b, 2000 + b // 5, f"{b:02}", *rng.sample("abcd", 2), None if b == 7 else rng.randrange(30), 11, b % 4 == 0, 1.0, 0.0) for x in ("L", None) for b in range(15)]
    df = spark.createDataFrame(rows, "league string, block_ord int, season int, game string, home string, away string, home_score int, away_score int, neutral boolean, home_adjustment double, away_adjustment double")
    configs = {f"c{k}": Rating(carry_back=k / 4) for k in range(3)}
    kept = lambda d: sorted(map(repr, d.collect()))
    one = [kept(ratings.rating_ledger(df, {n: c})) for n, c in configs.items()]
    whole = ratings.rating_ledger(df, configs)
    assert sorted(sum(one, [])) == kept(whole) and whole.count() == 3 * 2 * 30
    monkeypatch.setattr(ratings, "SETS", 2)
    assert kept(ratings.rating_ledger(df, configs)) == kept(whole)
    early = ratings.rating_ledger(df.where("season < 2001"), configs)
    late = ratings.rating_ledger(df.where("season >= 2001 and league = 'L'"), configs, ratings.rating_state(early, configs).where("league = 'L'"))
    near = lambda d: sorted((r.config, r.game, r.side, round(r.after, 9)) for r in d.collect())
    assert near(late) == near(whole.where("season >= 2001 and league = 'L'"))
    assert "Generate" in whole._jdf.queryExecution().executedPlan().toString()


def test_lattice_with_given_totals_makes_residuals_once(spark):
    from tidemark.operators import offers

    rows = [(b, "spread", s, line, 1.5, 20 if b else None) for b in (0, 1) for s in ("home", "away") for line in (-3.0, 2.5)]
    o = spark.createDataFrame(rows, "b int, market string, side string, line double, predicted double, n_left long")
    left = spark.createDataFrame([(1, k - 10.0, 1) for k in range(20)], "b int, r double, n long")
    want = offers.lattice_probabilities(o, left, ["b"])
    got = offers.lattice_probabilities(o, left, ["b"], "predicted", "n_left")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and sum(r.p_win is not None for r in got.collect()) == 4
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(n" in plan(want) and "sum(n" not in plan(got)


def test_a_totals_table_reads_and_deals_its_plays_once(spark):
    """F14. Plays, drives and intervals come of one exchange; unplayed pairs keep their flags though a side is null, and games of one pair and block share their rates."""
    flags = dict.fromkeys(("play_deleted", "aborted_play", "rush_attempt", "complete_pass", "qb_kneel", "qb_spike", "sack", "interception", "fumble_lost", "goal_to_go"), 0.0)
    play = lambda game, k, team, drive, result, clock, kind="pass", **more: {
        "game": game, "play_id": k, "drive": drive, "posteam": team, "defteam": "x", "play_type": kind, "air_yards": 1.0, "yards_after_catch": 1.0, "pass_attempt": 1.0, "qb_dropback": 1.0,
        "epa": 0.5, "success": 1.0, "qtr": 1, "score_differential": 0, "game_seconds_remaining": clock, "yardline_100": 10, "yards_gained": 5, "result": result, **flags, **more,
    }
    # a punt between two plays makes no interval and none ends across it at another clock; a drive's first known result counts
    rows = [play(g, k, "a", k // 4, None if k % 4 == 0 else "Touchdown" if k % 4 == 1 else "Punt", 3600 - 10 * k, "punt" if k % 4 == 2 else "pass") for g in (1, 2) for k in range(40)]
    plays = spark.createDataFrame(rows)
    summed = pipelines.play_sums(plays, ["game", "posteam"])
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") <= 2
    got = summed.where("game = 1").first()
    assert (got.epa_per_play_n, got.epa_per_play_num) == (30, 15.0)
    assert (got.points_per_drive_n, got.points_per_drive_num, got.scoring_drive_rate_num, got.turnovers_per_drive_num) == (10, 70.0, 10.0, 0.0)
    assert (got.red_zone_td_rate_n, got.red_zone_td_rate_num, got.goal_to_go_td_rate_n) == (10, 10.0, 0)
    # three valid plays a drive: the intervals are 10 and 20 seconds
    assert (got.seconds_per_play_n, got.seconds_per_play_num) == (20, 300.0)

    games = spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "a", "b"), (3, 2, "a", "b"), (4, 2, "a", "b"), (5, 2, "a", None)], "game int, block_ord int, home string, away string")
    context = spark.createDataFrame([], "game int, away_rest int, home_rest int, roof string, surface string")
    passers = spark.createDataFrame([], "game int, side string, " + ", ".join(f"{c} double" for c in pipelines.PASSER))
    out = {r.game: r for r in pipelines.totals_table(plays, games, context, passers, lambda rate: rate * 2).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5] and out[3].home_matchup_epa_per_play == out[4].home_matchup_epa_per_play == 1.0
    assert (out[3].away_matchup_epa_per_play_missing, out[1].home_matchup_epa_per_play_missing, out[5].home_matchup_epa_per_play_missing) == (1, 1, 1)


def test_intervals_among_some_events_are_those_of_the_others_left_out(spark):
    """F14. An event that doesn't count stays, makes no interval, and is skipped by the next one."""
    from tidemark.operators import events

    rows = [("g", k, k % 3 == 1, None if k == 4 else 100.0 - k * k, k // 5, k % 2 == 0) for k in range(12)]
    df = spark.createDataFrame(rows, "g string, k int, off boolean, clock double, q int, f boolean")
    want = events.intervals(df.where("not off"), ["g"], ["k"], "clock", ["q"], before=["f"]).orderBy("k").collect()
    got = events.intervals(df, ["g"], ["k"], "clock", ["q"], before=["f"], among=~F.col("off")).orderBy("k").collect()
    assert [r for r in got if not r.off] == want
    assert [(r.seconds, r.valid_interval) for r in got if r.off] == [(None, False)] * 4
