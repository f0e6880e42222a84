"""Projections, unions, matching helpers and views that the queries don't reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import quality
from tidemark.operators import asof, history, identity, offers, reshape, snapshots


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_projections(spark):
    df = spark.createDataFrame([(1, " Dome ", None), (2, "", 3.5), (3, None, None)], "id int, roof string, wind double")
    assert rows(reshape.context(df, ["wind"], ["roof"]), "id", "roof", "wind_missing") == [(1, "dome", 1), (2, "unknown", 0), (3, "unknown", 1)]
    assert reshape.projected(df, {"key": "id"}).columns == ["key"]
    with pytest.raises(Exception, match="nope"):
        reshape.projected(df, {"x": "nope"}).columns
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("gone", T.StringType())])
    out = reshape.standardised(df, schema, {"k": ["missing", "id"]})
    assert out.schema == schema or [f.dataType for f in out.schema] == [f.dataType for f in schema]
    assert rows(out, "k", "gone") == [(1, None), (2, None), (3, None)]
    assert reshape.model_columns(df, ["w", "r"]) == ["wind"] and reshape.model_columns(df, ["w", "r"], text=True) == ["roof", "wind"]
    assert rows(df.select("id", reshape.warm("wind", F.col("id") < 3).alias("p")), "id", "p") == [(1, None), (2, None), (3, None)]


def test_candidate_table(spark):
    base = spark.createDataFrame([(1, "x", 9), (2, "y", 8)], "id int, side string, home_score int")
    ctx = spark.createDataFrame([(1, 0.5)], "id int, p double")
    out = reshape.outcome_free(base, ["home_score"], [ctx], ["id"])
    assert out.columns == ["id", "side", "p"] and rows(out, "id", "p") == [(1, 0.5), (2, None)]


def test_unions(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(3, "q")], "k int, y string")
    assert rows(reshape.stacked([a, b], widen=True), "k", "x", "y") == [(1, 2, None), (3, None, "q")]
    with pytest.raises(Exception, match="y|x"):
        reshape.stacked([a, b]).collect()
    schema = T.StructType([T.StructField("k", T.LongType())])
    assert reshape.stacked([a, b], schema=schema).dtypes == [("k", "bigint")]
    assert rows(reshape.side_by_side([a, b], ["k"]), "k", "x", "y") == [(1, 2, None), (3, None, "q")]
    m = spark.createDataFrame([(1, "home"), (1, "away"), (2, "over"), (2, "over")], "g int, side string")
    assert rows(reshape.canonical_side(m, "side", ["home", "over"], ["g"]), "g", "side") == [(1, "home"), (2, "over")]


def test_cascade(spark):
    df = spark.createDataFrame([(1, ["a"], "OVERRIDE", ["b"], "DEPTH"), (2, None, "UNKNOWN", ["b"], "DEPTH"), (3, None, "UNKNOWN", None, None)], "id int, c1 array<string>, s1 string, c2 array<string>, s2 string")
    assert rows(asof.cascade(df, [("c1", "s1"), ("c2", "s2")]), "id", "candidates", "state") == [(1, ["a"], "OVERRIDE"), (2, ["b"], "DEPTH"), (3, None, "UNKNOWN")]


def test_evidence_before_the_cutoff_only(spark):
    cut = dt.datetime(2024, 9, 10, 12)
    ev = [("B", "late", 1, cut + dt.timedelta(seconds=1)), ("B", "b1", 1, cut), ("A", "a1", 1, cut - dt.timedelta(seconds=1)), ("A", "a2", 1, cut), ("A", None, 1, cut), ("C", "c1", 2, cut), ("C", "c1", 1, cut - dt.timedelta(days=1)), ("C", "c2", 3, cut)]
    e = spark.createDataFrame(ev, "team string, c string, r int, t timestamp")
    t = spark.createDataFrame([(x, cut) for x in "ABCD"], "team string, cut timestamp")
    got = {r.team: (r.candidates, r.state) for r in asof.resolved(t, e, ["team"], "c", "r", "t", "cut", "SUPPORTED").collect()}
    assert got == {"A": (["a1", "a2"], "AMBIGUOUS"), "B": (["b1"], "SUPPORTED"), "C": (["c1"], "SUPPORTED"), "D": (None, "UNKNOWN")}


def test_names_of_a_game(spark):
    r = spark.createDataFrame([("g", "LA"), ("g", "SF"), ("h", "XX")], "game string, team string")
    m = spark.createDataFrame([("g", "LA", "LAR"), ("g", "SF", "SF"), ("h", "YY", "A"), ("h", "YY", "B")], "game string, src string, canon string")
    out, gates = identity.canonical_names(r, m, "game", "team", "src", "canon")
    assert rows(out, "game", "team") == [("g", "LAR"), ("g", "SF"), ("h", "XX")]
    assert {x.gate for x in gates.collect()} == {"alias_ambiguous", "alias_unknown"}


def test_one_to_one_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    out, gates = identity.guarded_join(a, b, ["k"])
    quality.assert_clean(gates)
    assert rows(out, "k", "v") == [(1, 5), (2, 6)]
    want = spark.createDataFrame([(2, 0), (1, 1), (9, 2)], "k int, n int")
    assert [r.v for r in identity.ordered_as(b, want, "k", "n").orderBy("n").collect()] == [6, 5, None]


def test_views_of_runs(spark):
    t = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([("r1", "s", t, "COMMITTED"), ("r2", "s", t + dt.timedelta(1), "FAILED"), ("r3", "s", t + dt.timedelta(2), "COMMITTED")], "run_id string, src string, at timestamp, status string")
    data = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3), ("r3", 4)], "run_id string, x int")
    assert rows(snapshots.committed(data, h, "run_id"), "x") == [(1,), (3,), (4,)]
    assert rows(snapshots.latest_successful(h, "src", "at"), "run_id") == [("r3",)]
    assert rows(snapshots.latest_successful(h, "src", "at", before="2024-01-02"), "run_id") == [("r1",)]
    att = spark.createDataFrame([("r1", "failed"), ("r1", "success"), ("r2", "failed")], "run_id string, outcome string")
    walk = spark.createDataFrame([("r3", "MATCHED"), ("r3", "CONFLICT")], "run_id string, status string")
    assert rows(snapshots.assembled_runs(h, att, data, walk), "run_id", "n_attempts", "n_success", "n_rows", "n_matched") == [("r1", 2, 1, 1, 0), ("r3", 0, 0, 2, 1)]


def test_recency_mean_passes_over_nulls(spark):
    f = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, 20.0), ("b", 1, None)], "e string, t int, v double")
    got = rows(history.recency_mean(f, ["e"], ["t"], "v", 2, 0.5, "m"), "e", "t", "m")
    assert got == [("a", 1, 10.0), ("a", 2, 10.0), ("a", 3, pytest.approx((20 + 5) / 1.5)), ("b", 1, None)]


def test_per_season_and_histogram(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "s int, g string, b int")
    assert rows(offers.per_season(df, "s", {"low": F.col("b") == 1}), "s", "n", "low") == [(1, 2, 1), (2, 1, 1)]
    assert rows(offers.distinct_histogram(df, ["g"], "b"), "n_distinct", "n_groups") == [(1, 2)]


def test_more_gates(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "g int"), spark.createDataFrame([(1,), (1,), (3,)], "g int")
    assert quality.complete_blocks(a, b, ["g"]).count() == 3
    bad = spark.createDataFrame([(True, False, 3), (None, True, 0), (True, False, -1), (None, False, None)], "w boolean, t boolean, m int")
    assert quality.invariants(bad, quality.outcome_rules("w", "t", "m")).first().n == 1
    f = spark.createDataFrame([(1, 2, False), (3, 2, False), (2, 2, True)], "a int, c int, own boolean")
    assert tuple(quality.leakage(f, "a", "c", F.col("own")).first()) == (1, 1, 1)
    s = spark.createDataFrame([("x", 1.0)], "k string, n double")
    assert quality.changed_summaries(s, s.withColumn("n", F.lit(3.0)), ["k"]).first().n_delta == 2.0
    assert quality.utc_columns(s, ["n"]).count() == 1
