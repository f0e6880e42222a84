"""Streams fed by files or rate-free memory, held against the batch results."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from tidemark.functions import Rating
from tidemark.models import ratings
from tidemark.streaming import jobs

START = dt.datetime(2024, 1, 1)


def run(spark, df, tmp_path, mode="append", conf=None):
    old = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        return spark.table("out").collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def landed(spark, rows, schema, tmp_path, parts=2):
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_block_sums_turn_on_tuesday_noon(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 2, 11, 59), 1.0), ("a", dt.datetime(2024, 1, 2, 12), 2.0), ("a", dt.datetime(2024, 1, 9, 11), 3.0), ("a", dt.datetime(2024, 3, 1), 9.0)]
    s = landed(spark, rows, "k string, ts timestamp, v double", tmp_path, 1)
    got = {str(r.as_of): (r.num, r.n) for r in run(spark, jobs.block_sums(s, "ts", ["k"], "v"), tmp_path, "complete")}
    assert got["2023-12-26 12:00:00"] == (1.0, 1) and got["2024-01-02 12:00:00"] == (5.0, 2)


def test_reliability_windows(spark, tmp_path):
    rows = [("s", START + dt.timedelta(hours=h), "success" if h % 2 else "failed") for h in range(6)]
    got = run(spark, jobs.reliability_windows(landed(spark, rows, "src string, ts timestamp, o string", tmp_path, 1), "ts", "src", "o"), tmp_path, "complete")
    assert max(r.n_attempts for r in got) == 6 and max(r.n_success for r in got) == 3


def test_commit_once(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    s = landed(spark, [(1, "a"), (2, "b"), (2, "b"), (3, "c")], "k int, v string", tmp_path)
    q = jobs.commit_once(s, str(tmp_path / "ledger"), schema, "k", str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == [1, 2, 3]


def test_usable(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (None, 2)], "a int, c int")
    assert [r.usable for r in jobs.usable(df, "a", "c").collect()] == [True, True, False, False]


def test_change_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("p", START, "x", None), ("p", START + dt.timedelta(1), "y", None), ("q", START, "z", "1"), ("p", START + dt.timedelta(2), None, "5"), ("p", START, "late", None)]
    got = run(spark, jobs.change_stream(landed(spark, rows, "key string, at timestamp, a string, b string", tmp_path), ["a", "b"]), tmp_path, "append", ROCKS)
    assert sorted((r.key, r.field or "", r.change_type) for r in got) == [("p", "", "first_seen"), ("p", "a", "changed"), ("p", "a", "cleared"), ("p", "b", "populated"), ("q", "", "first_seen")]


def test_rating_stream_equals_the_batch_fold(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("L", b, 2000, f"{b}", "abc"[b % 3], "abc"[(b + 1) % 3], b * 7 % 30, b * 5 % 30) for b in range(20)]
    s = landed(spark, [(r[0], r[1], *r[3:]) for r in rows], "league string, block_ord int, game string, home string, away string, home_score int, away_score int", tmp_path)
    got = {r.game: r.change for r in run(spark, jobs.rating_stream(s), tmp_path, "append", ROCKS)}
    schema = "league string, block_ord int, season int, game string, home string, away string, home_score int, away_score int, neutral boolean, home_adjustment double, away_adjustment double"
    batch = ratings.rating_ledger(spark.createDataFrame([(*r, False, 0.0, 0.0) for r in rows], schema), {"x": Rating()}).where("side = 'home'")
    assert got == pytest.approx({r.game: r.change for r in batch.collect()})


def test_staleness_alarm(spark, tmp_path):
    """A source that falls silent raises one alarm; its timer runs on processing time, in batches without data."""
    import time

    pytest.importorskip("google.protobuf")
    s = landed(spark, [("a", START), ("b", START)], "source string, at timestamp", tmp_path, 1)
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    q = jobs.staleness_stream(s, 500).writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("alarms").count() < 2 and q.isActive:
            time.sleep(1)
        assert q.exception() is None
        assert sorted((r.source, r.state) for r in spark.table("alarms").collect()) == [("a", "STALE_LAST_SUCCESS"), ("b", "STALE_LAST_SUCCESS")]
    finally:
        q.stop()
        for k in ROCKS:
            spark.conf.unset(k)


def test_rating_stream_carries_seasons_and_skips_unplayed_games(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("L", b, 2000 + b // 7, f"{b:02}", "abc"[b % 3], "abc"[(b + 1) % 3], None if b % 6 == 5 else b * 7 % 30, b * 5 % 30, b % 4 == 0, float(b % 3), 1.0) for b in range(20)]
    schema = "league string, block_ord int, season int, game string, home string, away string, home_score int, away_score int, neutral boolean, home_adjustment double, away_adjustment double"
    got = {r.game: (r.p_home, r.change) for r in run(spark, jobs.rating_stream(landed(spark, rows, schema, tmp_path)), tmp_path, "append", ROCKS)}
    batch = ratings.rating_ledger(spark.createDataFrame(rows, schema), {"x": Rating()}).where("side = 'home'").collect()
    assert len(got) == 20 and got == {r.game: (pytest.approx(r.p), pytest.approx(r.change)) for r in batch}


def test_a_stream_takes_up_a_ledgers_state_once(spark, tmp_path):
    """F3. Ratings to begin with come in the first batch as rows of their own, not beside each game of each batch; a league may come later, be new, or have no games."""
    pytest.importorskip("google.protobuf")
    schema = "league string, block_ord int, season int, game string, home string, away string, home_score int, away_score int, neutral boolean, home_adjustment double, away_adjustment double"
    row = lambda name, b: (name, b, 2000 + b // 7, f"{b:02}", "abc"[b % 3], "abc"[(b + 1) % 3], None if b % 6 == 5 else b * 7 % 30, b * 5 % 30, b % 4 == 0, float(b % 3), 1.0)
    early = [row(name, b) for name in ("L", "M", "idle", None) for b in range(10)]
    late = [row("L", b) for b in range(10, 20)] + [row(None, b) for b in range(10, 16)] + [row(name, b) for b in range(16, 24) for name in ("M", "new")]
    config = {"x": Rating()}
    state = ratings.rating_state(ratings.rating_ledger(spark.createDataFrame(early, schema), config), config)
    state = spark.createDataFrame([*state.where("league is not null").collect(), (None, "x", "a", 1600.0, 2001)], state.schema)
    stream = jobs.rating_stream(landed(spark, late, schema, tmp_path, 4), config["x"], state, shares=2)
    assert "Join" not in stream._jdf.queryExecution().analyzed().toString()
    got = {(r.league, r.game): (r.p_home, r.change) for r in run(spark, stream, tmp_path, "append", ROCKS)}
    whole = ratings.rating_ledger(spark.createDataFrame(early + late, schema).where("league is not null"), config).where("side = 'home'").collect()
    want = {(r.league, r.game): (pytest.approx(r.p), pytest.approx(r.change)) for r in whole}
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: want[k] for k in ((r[0], r[3]) for r in late) if k[0] is not None}
    assert sum(k[0] is None for k in got) == 6 and len(got) == len(late)
