"""Running values, ranks and quantiles over ranges, against windows and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import asof, evaluation, history, offers, scan


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", None, "b"]), rng.randrange(50), k, rng.choice([None, rng.randrange(-9, 9)]), rng.choice([None, None, f"v{k}"])) for k in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(3000), "g string, t int, k int, x long, s string").repartition(5).cache()


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("by", [["g"], []])
def test_running_equals_windows(frame, by, own):
    w = Window.partitionBy(*by).orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    want = frame.withColumns({"total": F.sum("x").over(w), "seen": F.last("s", ignorenulls=True).over(w), "n": F.sum(F.lit(1)).over(w)})
    got = scan.running(frame, by, ["t", "k"], {"total": "x", "n": F.lit(1)}, {"seen": "s"}, own)
    key = lambda df: sorted(map(tuple, df.select("k", "g", "t", "x", "s", "total", "seen", "n").collect()))
    assert key(got) == key(want)


def test_a_hot_group_is_spread(spark):
    df = spark.range(200_000).selectExpr("'hot' as g", "id as t", "id % 7 as x").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join so few rows
    try:
        out = scan.running(df, ["g"], ["t"], {"total": "x"})
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and max(sizes) <= 100_000 and len(sizes) >= 3
    assert out.agg(F.max("total")).first()[0] == sum(k % 7 for k in range(200_000))


def single(df):
    return "SinglePartition" in df._jdf.queryExecution().executedPlan().toString()


def test_no_task_gets_all_values(spark):
    df = spark.range(1000).selectExpr("id", "cast(id * 37 % 101 as double) as p", "cast(id % 2 as int) as y", "id % 4 as block")
    ranked = evaluation.average_rank(df, "p", "r")
    assert not single(ranked)
    r = {x.id: x.r for x in ranked.collect()}
    p = [k * 37 % 101 for k in range(1000)]
    order = sorted(p)
    assert all(r[k] == order.index(p[k]) + 1 + (p.count(p[k]) - 1) / 2 for k in range(0, 1000, 37))
    # what is left for one task are the one-row results of aggregates
    for out in (evaluation.auc(df, "p", "y"), evaluation.regression_scores(df, "p", "y", "block")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and all("Window" not in line for line in plan.split("SinglePartition")[0].splitlines()[-3:])


def test_asof_in_slices(spark):
    rng = random.Random(4)
    facts = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randrange(300)]), k, rng.choice([None, k])) for k in range(2000)], "e string, at int, k int, v int").repartition(4)
    targets = spark.createDataFrame([(rng.choice(["hot", "hot", "b", "none", None]), rng.choice([None, rng.randrange(300)]), k) for k in range(500)], "e string, cut int, id int")
    make = lambda sliced: sorted(map(str, asof.asof(targets, facts, ["e"], "cut", "at", ["v", "k"], ["k"], sliced=sliced).collect()))
    assert make(True) == make(False)


def test_states_and_profits_in_slices(frame):
    updates = frame.select(F.col("g").alias("key"), F.col("t").alias("block_ord"), F.col("x").alias("num"), F.lit(1).cast("long").alias("den"), F.lit(1).cast("long").alias("n"))
    one, two = (sorted(map(str, history.entering_state(updates, ["key"], sliced=s).collect())) for s in (True, False))
    assert one == two
    one, two = (sorted(map(str, offers.running_profit(frame, ["g"], ["t", "k"], "x", sliced=s).select("k", "bet_no", "cum_wins", "cum_profit").collect())) for s in (True, False))
    assert one == two


VALUES = {
    "plain": [random.Random(7).gauss(0, 10) for _ in range(800)], "ties": [1.0] * 500 + [2.0, 3.0], "one": [4.5], "two": [1.0, 2.0], "far": [-1e308, 1e308, 1e-300, 5.0, -1e-300, 0.0, 1e300],
    "close": [1.0 + k * 2**-52 for k in range(200)], "zero": [0.0, -0.0, 0.0], "infinite": [math.inf, 1.0, 2.0, -math.inf, 3.0], "skew": [2.0**k for k in range(-400, 400, 7)],
}


@pytest.mark.parametrize("ranges", [4096, 2])
def test_quantiles(spark, ranges):
    names = ["plain", "ties", "one", "two", "far", "close", "zero"] if ranges == 2 else [n for n in VALUES if n != "infinite"]
    data = [(n, v) for n in names for v in VALUES[n]] + [(None, v) for v in (3.0, 1.0)] + [("plain", None), ("plain", math.nan), ("nothing", None)]
    random.Random(3).shuffle(data)
    at = {"low": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "high": 1.0}
    got = {r.g: r for r in scan.quantiles(spark.createDataFrame(data, "g string, v double").repartition(3), "v", at, ["g"], ranges=ranges).collect()}
    assert set(got) == {*names, None}
    for n in [*names, None]:
        values = VALUES[n] if n else [3.0, 1.0]
        assert got[n].n == len(values)
        for name, q in at.items():
            with np.errstate(over="ignore"):
                spot = q * (len(values) - 1)
                a, b = sorted(values)[math.floor(spot)], sorted(values)[math.ceil(spot)]
                assert got[n][name] == pytest.approx(a + (spot - math.floor(spot)) * (b - a), rel=1e-12)


def test_weighted_and_global_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (2.0, 0), (7.0, 2), (9.0, None), (None, 4)], "v double, n int")
    assert [tuple(r) for r in scan.quantiles(df, "v", {"m": 0.5, "h": 1.0}, weight="n").collect()] == [(6, 3.0, 7.0)]
    assert scan.quantiles(df.limit(0), "v", {"m": 0.5}).collect() == []
    big = spark.range(50_000).selectExpr("cast(id * 7919 % 50000 as double) as v")
    out = scan.quantiles(big, "v", {"m": 0.5, "p": 0.37})
    assert [tuple(r) for r in out.collect()] == [(50_000, 24_999.5, pytest.approx(0.37 * 49_999))]
    assert evaluation.robust_scale(big, "v").first().scale == pytest.approx(1.4826 * 12_500)
