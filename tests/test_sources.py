"""Readers, sinks and composite pipelines on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import quality
from tidemark.operators import identity
from tidemark.plans import pipelines
from tidemark.sources import readers, sinks


def snapshot(at, events_):
    return {"timestamp": at, "data": events_}


def event(ident, home, away, books):
    return {"id": ident, "commence_time": "2024-09-08T17:00:00Z", "home_team": home, "away_team": away, "bookmakers": [{"key": b, "title": b, "last_update": "2024-09-08T16:00:00Z", "markets": m} for b, m in books]}


def market(key, *outcomes):
    return {"key": key, "last_update": "2024-09-08T16:00:00Z", "outcomes": [{"name": n, "price": p, "point": x} for n, p, x in outcomes]}


@pytest.fixture
def quotes_dir(tmp_path):
    good = [market("h2h", ("A", 120.0, None), ("B", -140.0, None)), market("spreads", ("A", -110.0, -3.5), ("B", -110.0, 3.5)), market("totals", ("Over", -110.0, 44.5), ("Under", -110.0, 44.5))]
    bad = [market("spreads", ("A", -110.0, -3.5), ("B", -110.0, 3.0)), market("h2h", ("A", 1.0, None)), market("odd", ("A", 1.0, None), ("B", 1.0, None))]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.json").write_text(json.dumps(snapshot("2024-09-08T16:05:00Z", [event("e1", "A", "B", [("x", good), ("y", bad)]), event("e2", "C", "D", [])]), indent=1))
    (tmp_path / "q" / "2.json").write_text(json.dumps(snapshot("2024-09-08T16:05:00", [])))
    return str(tmp_path / "q")


def test_quote_snapshots(spark, quotes_dir):
    rows = readers.quote_snapshots(spark, quotes_dir).collect()
    assert len(rows) == 6 + 5 + 1 + 1
    assert {(r.book, r.market, r.valid) for r in rows if r.book} == {("x", "h2h", True), ("x", "spreads", True), ("x", "totals", True), ("y", "spreads", False), ("y", "h2h", False), ("y", "odd", False)}
    assert {r.side for r in rows if r.market == "totals"} == {"over", "under"}
    assert [r.snapshot_at for r in rows if r.file.endswith("2.json")] == [None]


def test_canonical_quotes(spark, quotes_dir):
    targets = spark.createDataFrame([("g1", "2024-09-08", "B", "A"), ("g2", "2024-09-08", "X", "Y")], "game string, day string, home string, away string").withColumn("day", F.col("day").cast("date"))
    games, quotes, coverage = pipelines.canonical_quotes(readers.quote_snapshots(spark, quotes_dir), targets, ["h2h", "spreads", "totals"])
    g = {r.game: r for r in games.collect()}
    assert g["g1"].match_status == "MATCHED" and g["g1"].lead_minutes == 55.0 and g["g1"].complete_books == ["x"] and g["g1"].flags == ["MALFORMED"]
    assert g["g2"].match_status == "UNMATCHED" and quotes.count() == 11 and {(r.h, r.n) for r in coverage.select(F.col("book").alias("h"), F.col("n_complete").alias("n")).collect()} == {("x", 1)}


def test_quote_stream_equals_the_batch(spark, quotes_dir, tmp_path):
    from tidemark.streaming import jobs

    q = jobs.quote_stream(spark, quotes_dir).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = readers.quote_snapshots(spark, quotes_dir)
    assert spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_delimited_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Rk,Player,Day,G#,Week,Date,Age,Team,,Opp,Result,Pos.,Player-additional\n1,\"Doe, J\",Sun,1,1,2024-09-08,25,AAA,@,BBB,\"W 1,2\",QB,doe1\n2,Roe,Sun,2,2,2024-09-15,25,AAA,BYE,x,y,roe1\n3,short\n3,a,b,c,d,e,f,g,h,i,j,k,l,m\n")
    rows, bad = readers.delimited_log(spark, str(tmp_path / "a.csv"))
    got = {r.Rk: r for r in rows.collect()}
    assert got["1"].Player == "Doe, J" and got["1"].Result == "W 1,2" and got["1"]["Player-additional"] == "doe1" and not got["1"].repaired
    assert got["2"].repaired and got["2"]._at is None and got["2"].Opp == "BYE" and got["2"]["Player-additional"] == "roe1"
    assert bad.count() == 2
    assert sorted((r.number, r.problem) for r in identity.sequence_gaps(rows.select("Rk"), "Rk", 1, 3).collect()) == [(3, "MISSING")]


def test_keyed_objects(spark):
    text = spark.createDataFrame([('{"1": {"name": "A", "active": true}, "2": {"name": "B"}, "3": 7, "4": "x"}',)], "t string")
    good, idle, bad = readers.keyed_objects(text, "t", "name string, active boolean", F.col("active"))
    assert [r.key for r in good.collect()] == ["1"] and [r.key for r in idle.collect()] == ["2"] and sorted(r.key for r in bad.collect()) == ["3", "4"]


def test_verified_files(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n * 10)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m = spark.createDataFrame([("a", 10, sha("a" * 10)), ("b", 10, sha("x")), ("c", 9, sha("c" * 10)), ("d", 1, "")], "name string, bytes long, sha256 string")
    assert {(r.name, r.problem) for r in readers.verified_files(spark, str(tmp_path), m).collect()} == {("b", "SHA256"), ("c", "SIZE"), ("d", "MISSING")}


def test_requests_without_plan(spark):
    raw = spark.createDataFrame([("f1", 1), ("f2", 2)], "file string, x int")
    ledger = spark.createDataFrame([("f1", "r1")], "file string, request string")
    rows, gates = readers.with_requests(raw, spark.createDataFrame([], "request string, season int"), ledger, "request", "file")
    assert rows.count() == 0 and {r.gate for r in gates.collect()} == {"file_without_attempt", "attempt_without_plan"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    sinks.frozen(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.frozen(df, str(tmp_path / "t"))
    old = T.StructType([T.StructField("k", T.IntegerType())])
    new = T.StructType([*old.fields, T.StructField("s", T.StringType())])
    path = str(tmp_path / "ledger")
    sinks.append(df.select("k"), path, old)
    sinks.append(spark.createDataFrame([(2, "b")], df.schema), path, new)
    assert sorted(map(tuple, sinks.ledger(spark, path).select("k", "s").collect())) == [(1, None), (2, "b")]
    with pytest.raises(ValueError):
        sinks.append(df, path, old)
    sinks.csv_report(df, str(tmp_path / "csv"), ["k"])
    sinks.ndjson(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_append_widens_and_reads_old_files(spark, tmp_path):
    schema, path = T.StructType([T.StructField("k", T.IntegerType())]), str(tmp_path / "w")
    sinks.append(spark.createDataFrame([(1,)], "k int"), path, schema)
    wider = sinks.append(spark.createDataFrame([(2, "x")], "k long, s string"), path, schema, widen=True)
    assert wider.names == ["k", "s"] and sorted(map(tuple, sinks.ledger(spark, path).collect())) == [(1, None), (2, "x")]


def test_append_once_keeps_snapshots_whole(spark, tmp_path):
    """All rows of a snapshot, equal ones once; a repeated batch writes the same again, another batch adds nothing."""
    df = spark.createDataFrame([("s1", 1), ("s1", 2), ("s1", 2), ("s2", 1), (None, 5)], "snap string, v int")
    path, schema = str(tmp_path / "once"), df.schema
    for batch in (0, 0, 1):
        sinks.append_once(df, path, schema, "snap", batch)
    sinks.append_once(df.union(spark.createDataFrame([("s3", 9)], df.schema)), path, schema, "snap", 2)
    assert sorted((r.snap or "", r.v) for r in sinks.ledger(spark, path).collect()) == [("", 5), ("s1", 1), ("s1", 2), ("s2", 1), ("s3", 9)]


def test_season_files_and_baseline(spark, tmp_path):
    for y in (2020, 2021):
        spark.createDataFrame([(y * 10,)], "g int").write.parquet(str(tmp_path / str(y)))
    df = readers.season_files(spark, {y: str(tmp_path / str(y)) for y in (2020, 2021)})
    assert sorted(map(tuple, df.collect())) == [(20200, 2020), (20210, 2021)]
    s = spark.createDataFrame([("g", 2020, 1, "2020-09-13", "LA ", "b", 1, 2, "Neutral")], "game_id string, season int, week int, gameday string, home_team string, away_team string, home_score int, away_score int, location string")
    v = spark.createDataFrame([("v1", "Z"), ("v1", "A"), (None, "B")], "venue_id string, name string")
    b = readers.baseline(s, v, {"LA": "LAR"})
    assert b["games"].first().home == "LAR" and b["games"].first().neutral and [r.name for r in b["venues"].collect()] == ["A"]


def test_reconciliation(spark):
    games = spark.createDataFrame([("g1", "d1", "A", "B"), ("g2", "d2", "A", "C"), ("g3", "d3", "D", "E"), ("g4", "d3", "E", "D")], "game string, day string, home string, away string")
    raw = spark.createDataFrame([(1, "d1", "B", "A", "p"), (2, "d9", "A", "C", "p"), (3, "d3", "D", "E", "p")], "row_id int, day string, team string, opponent string, player string")
    final, why, gates = pipelines.reconciled(raw, games, spark.createDataFrame([(2, "g2"), (3, "g3")], "row_id int, game string"))
    quality.assert_clean(gates)
    assert {r.row_id: r.game for r in final.collect()} == {1: "g1", 2: "g2", 3: "g3"}
    assert {r.row_id: r.diagnosis for r in why.collect()} == {2: "DATE_MISMATCH", 3: "LOCATION_MISMATCH"}


def test_snapshot_audit(spark):
    schema = "id string, name string, injury_status string, practice_participation string, roster_status string, depth_chart_order int"
    before = spark.createDataFrame([("1", "A", None, None, None, 1)], schema)
    after = spark.createDataFrame([("1", "A", "Out", None, None, 1), ("2", "B", None, None, "Active", 2)], schema)
    ref = spark.createDataFrame([(7, "1")], "target int, ext string")
    out = pipelines.snapshot_audit(before, after, ref, "id", ["injury_status", "name"], [("ext", "id", "ext")], "target")
    assert {(r.what, r.value, r.n) for r in out["counts"].collect()} == {("state", "DEPTH_CHART_EXPECTED_OUT", 1), ("state", "BACKUP_CANDIDATE", 1), ("status", "MATCHED", 1), ("status", "UNMATCHED", 1), ("change_type", "populated", 1), ("change_type", "first_seen", 1)}


def test_actual_entering_state(spark):
    games = spark.createDataFrame([("g1", 2, "A", "B")], "game string, block_ord int, home string, away string")
    stats = spark.createDataFrame([("p", 0, 0.1, 30), ("p", 1, 0.2, 20), ("p", 2, 9.0, 90), ("q", 3, 1.0, 10)], "player string, block_ord int, value double, volume int")
    starters = spark.createDataFrame([("g1", "home", "p"), ("g1", "away", "q")], "game string, side string, player string")
    rows, gates = pipelines.actual_entering(games, stats, starters)
    quality.assert_clean(gates)
    got = {r.side: r.shrunk_value for r in rows.collect()}
    w = 50 / 300
    assert got["home"] == pytest.approx(w * (0.1 * 30 + 0.2 * 20) / 50 + (1 - w) * -0.05) and got["away"] == -0.05


def test_modeling_table_gates(spark):
    a, b = spark.createDataFrame([(1, 2)], "game int, x int"), spark.createDataFrame([(1, 3), (1, 4), (2, 5)], "game int, y int")
    _, gates = pipelines.modeling_table(a, b)
    assert gates.count() == 2


def test_scorecard(spark):
    df = spark.createDataFrame([(k, k % 2, k % 10 / 10 + 0.01 * (k % 2), k % 3) for k in range(60)], "k int, y int, p double, s int")
    card = pipelines.scorecard(df, "p", "y", ["s"], ["k"])
    assert card["metrics"].count() == 4 and card["worst"].count() == 20 and card["recalibration"].count() == 3 and 0 <= card["auc"].first().auc <= 1


def test_large_files_are_digested_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    sizes = {"a": 10, "b": 3_000_000, "c": 0, "d": 2_500_000}
    for k, (name, n) in enumerate(sizes.items()):
        (tmp_path / name).write_bytes(bytes([65 + k]) * n)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r._sha) for r in readers.digests(spark, str(tmp_path), streamed_bytes=1_000_000).collect()}
    assert got == {name: (n, hashlib.sha256(bytes([65 + k]) * n).hexdigest()) for k, (name, n) in enumerate(sizes.items()) if n}
    manifest = spark.createDataFrame([("a", 10, got["a"][1]), ("b", 3_000_000, got["d"][1]), ("d", 1, got["d"][1]), ("e", 1, "")], "name string, bytes long, sha256 string")
    found = {r.name: r.problem for r in readers.verified_files(spark, str(tmp_path), manifest, streamed_bytes=1_000_000).collect()}
    assert found == {"b": "SHA256", "d": "SIZE", "e": "MISSING"}


def test_modeling_contract(spark):
    from tidemark.plans import pipelines

    f = spark.createDataFrame([(1, 2020, 0.5), (2, 2020, 0.6), (3, 2021, 0.7)], "game int, season int, x double")
    s = spark.createDataFrame([(1, 3, 4), (2, 0, 0), (3, 7, 1)], "game int, home_score int, away_score int")
    names = ["game", "season", "x", "home_score", "away_score", "target_total_points"]
    rows, gates = pipelines.modeling_table(f, s, columns=names, width=6, expected={2020: 2, 2021: 1})
    assert gates.count() == 0 and sorted(map(tuple, rows.collect())) == [(1, 2020, 0.5, 3, 4, 7), (2, 2020, 0.6, 0, 0, 0), (3, 2021, 0.7, 7, 1, 8)]
    bad = lambda *a, **k: {r.gate for r in pipelines.modeling_table(*a, **k)[1].collect()}
    assert bad(f, s, columns=names[::-1]) == {"contract"} and bad(f, s, width=100) == {"contract"}
    assert bad(f, s, expected={2020: 3, 2021: 1}) == {"counts"}
    assert "target" in bad(f, s.withColumn("away_score", F.when(F.col("game") != 2, F.col("away_score"))))
    assert bad(f, s.where("game < 3")) and bad(f.withColumn("total_line", F.lit(1.0)), s)
