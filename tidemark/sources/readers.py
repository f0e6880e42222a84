"""Reading landed files: columnar tables, delimited logs, nested quote snapshots, keyed JSON objects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import quality
from tidemark.functions.text import to_string
from tidemark.functions.times import strict_timestamp
from tidemark.operators.offers import parsed_market


def table(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-01, SRC-07. A Parquet table of one or more paths; timestamps without a zone are read as UTC."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)})


def safe_scan(spark: SparkSession, path: str, columns: list[str], season: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """SRC-02. Only the listed columns within a window of seasons; both reach the scan, so outcome columns are never read.

    A bound that isn't given holds nothing back, rows without a season included.
    """
    df = spark.read.parquet(path).select(*columns)
    if season is not None and low is not None:
        df = df.where(F.col(season) >= low)
    if season is not None and high is not None:
        df = df.where(F.col(season) <= high)
    return df


def season_files(spark: SparkSession, paths: dict[int, str], season: str = "season") -> DataFrame:
    """SRC-07. One file a season, united by name, each row with the season its file stands for."""
    out = None
    for year, path in sorted(paths.items()):
        df = table(spark, path).withColumn(season, F.lit(year))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


#: SRC-03. The columns of a starter log. Fixed values.
STARTER_LOG = ["Rk", "Player", "Day", "G#", "Week", "Date", "Age", "Team", "_at", "Opp", "Result", "Pos.", "Player-additional"]


def delimited_log(spark: SparkSession, path: str, columns: list[str] = STARTER_LOG, bye: str = "BYE", gap: int = 8) -> tuple[DataFrame, DataFrame]:
    """SRC-03, SRC-04. Rows of comma-separated files, and the lines that could not be read, with their file.

    A line has the header's number of fields. One shape is known and repaired: a BYE line that lacks the field at
    `gap`. Header lines are left out. Fields are strings, trimmed, empty ones null.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE"}
    # one field more than the header, so that a longer line shows
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(columns) + 1)])
    n = F.size(F.split(F.regexp_replace("value", '"[^"]*"', "q"), ",", -1))
    parsed = lines.select("value", "file", n.alias("n"), F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    short = (F.col("n") == len(columns) - 1) & F.upper(F.col("value")).contains(bye)
    pick = lambda k: F.when(short & F.lit(k > gap), F.col(f"r.c{max(k - 1, 0)}")).when(short & F.lit(k == gap), F.lit(None)).otherwise(F.col(f"r.c{k}"))
    whole = (F.col("n") == len(columns)) | short
    rows = parsed.where(whole & (F.col("r.c0") != columns[0])).select(*(to_string(pick(k)).alias(c) for k, c in enumerate(columns)), short.alias("repaired"), "file")
    return rows, parsed.where(~whole).select("value", "file", "n")


#: SRC-05. A nested quote snapshot. Fixed values.
SNAPSHOT = "timestamp string, data array<struct<id string, commence_time string, home_team string, away_team string, bookmakers array<struct<key string, title string, last_update string, markets array<struct<key string, last_update string, outcomes array<struct<name string, price double, point double>>>>>>>>"


def unfolded(snapshots: DataFrame) -> DataFrame:
    """SRC-05, FN-23, FN-31. One row an outcome of snapshots that have the SNAPSHOT columns and file; empty levels leave a row with nulls."""
    event = snapshots.select("file", strict_timestamp("timestamp").alias("snapshot_at"), F.explode_outer("data").alias("e"))
    book = event.select("file", "snapshot_at", F.col("e.id").alias("event_id"), strict_timestamp("e.commence_time").alias("starts_at"), F.col("e.home_team").alias("home_team"), F.col("e.away_team").alias("away_team"), F.explode_outer("e.bookmakers").alias("b"))
    market = book.select("file", "snapshot_at", "event_id", "starts_at", "home_team", "away_team", F.col("b.key").alias("book"), F.explode_outer("b.markets").alias("m"))
    outcome = market.select("file", "snapshot_at", "event_id", "starts_at", "home_team", "away_team", "book", F.col("m.key").alias("market"), strict_timestamp("m.last_update").alias("quoted_at"), parsed_market("m.key", "m.outcomes").alias("valid"), F.explode_outer("m.outcomes").alias("o"))
    side = F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away").otherwise(F.lower("o.name"))
    return outcome.select(*[c for c in outcome.columns if c != "o"], F.col("o.name").alias("outcome"), side.alias("side"), F.col("o.price").alias("price"), F.col("o.point").alias("line"))


def quote_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05. The quotes in a folder of JSON snapshots, one document a file."""
    return unfolded(spark.read.schema(SNAPSHOT).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file")))


def keyed_objects(text: DataFrame, column: str, fields: str, active: Column, key: str = "key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-06. Of JSON objects keyed by id: active rows, inactive rows, and entries that are no records.

    fields: the records' schema. Entries are taken as text first, so one bad entry spoils no other.
    """
    entries = text.select(F.explode(F.from_json(column, "map<string,string>")).alias(key, "_raw"))
    rows = entries.withColumn("_r", F.when(F.col("_raw").rlike(r"^\s*\{"), F.from_json("_raw", fields)))
    good = rows.where("_r is not null").select(key, "_r.*")
    return good.where(F.coalesce(active, F.lit(False))), good.where(~F.coalesce(active, F.lit(False))), rows.where("_r is null").select(key, F.col("_raw").alias("entry"))


#: Files over this size are digested by streaming; smaller ones may be read whole.
STREAMED_BYTES, CHUNK = 256 << 20, 8 << 20


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files by path, read chunk by chunk."""
    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "_sha"])


def digests(spark: SparkSession, path: str, streamed_bytes: int = STREAMED_BYTES) -> DataFrame:
    """path, length and _sha of each file. Files of up to streamed_bytes are read whole, one a task's row; larger ones are
    opened by the tasks themselves and read in chunks, whatever their size, over any store that pyarrow knows. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= streamed_bytes).select("path", "length", F.sha2("content", 256).alias("_sha"))
    large = files.select("path", "length").where(F.col("length") > streamed_bytes)
    return small.unionByName(large.repartition("path").mapInArrow(_streamed, "path string, length long, _sha string"))


def verified_files(spark: SparkSession, path: str, manifest: DataFrame, streamed_bytes: int = STREAMED_BYTES) -> DataFrame:
    """SRC-09. Each file's name with what is wrong: SIZE, SHA256, UNEXPECTED or MISSING; none if all is well. manifest: name, bytes, sha256."""
    files = digests(spark, path, streamed_bytes).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_length"), "_sha")
    joined = manifest.join(files, "name", "full")
    problem = F.when(F.col("_length").isNull(), "MISSING").when(F.col("bytes").isNull(), "UNEXPECTED").when(F.col("bytes") != F.col("_length"), "SIZE").when(F.col("sha256") != F.col("_sha"), "SHA256")
    return joined.select("name", problem.alias("problem")).where("problem is not null")


def with_requests(raw: DataFrame, plan: DataFrame, ledger: DataFrame, request: str, file: str) -> tuple[DataFrame, DataFrame]:
    """SRC-10. Raw rows with their attempt and plan, and violations for files without an attempt and attempts without a plan."""
    joined = raw.join(ledger, file).join(plan, request)
    gates = quality.union(
        quality._violations(raw.select(file).distinct().join(ledger, file, "left_anti"), "file_without_attempt", F.col(file)),
        quality._violations(ledger.select(request).distinct().join(plan, request, "left_anti"), "attempt_without_plan", F.col(request)),
    )
    return joined, gates


def baseline(schedules: DataFrame, venues: DataFrame, team_alias: dict[str, str], team_stats: DataFrame | None = None, player_stats: DataFrame | None = None, depth: DataFrame | None = None, rosters: DataFrame | None = None) -> dict[str, DataFrame]:
    """SRC-08. Conformed tables of the sources that are given: games, venues, team_stats, passers, depth and rosters.

    Team names are aliased, players' ids trimmed (blank ones are null), sites are flags. One row a venue, the first by
    name. Passers are the rows of quarterbacks. What a source does not prove, the time at which a row was known, is null.
    """
    from tidemark.functions.text import alias
    from tidemark.operators.asof import first_per_key

    team = lambda c, name=None: alias(c, team_alias).alias(name or c)
    player = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("player_id")
    known = F.lit(None).cast("string").alias("observed_at")
    games = schedules.select("game_id", F.col("season").cast("int"), F.col("week").cast("int"), F.col("gameday").cast("date"), team("home_team", "home"), team("away_team", "away"), F.col("home_score").cast("int"), F.col("away_score").cast("int"), (F.lower(F.coalesce("location", F.lit(""))) == "neutral").alias("neutral"))
    out = {"games": games, "venues": first_per_key(venues.where("venue_id is not null"), ["venue_id"], [F.col("name").asc_nulls_last()])}
    when = ["game_id", "season", "week", "season_type"]
    if team_stats is not None:
        out["team_stats"] = team_stats.select(*when, team("team"), team("opponent_team", "opponent"), "passing_epa", "rushing_epa", "passing_yards", "rushing_yards", known)
    if player_stats is not None:
        out["passers"] = player_stats.where(F.upper("position") == "QB").select(*when, team("team"), player("player_id"), "player_name", "passing_epa", "passing_cpoe", "attempts", "sacks_suffered", "passing_interceptions", known)
    if depth is not None:
        quality_ = F.lit("batch_or_source_defined").alias("timestamp_quality")
        out["depth"] = depth.select("season", "week", team("team"), player("gsis_id"), "player_name", "pos_name", "pos_slot", "pos_rank", F.col("dt").alias("source_dt"), quality_, known)
    if rosters is not None:
        out["rosters"] = rosters.select("season", "week", team("team"), player("gsis_id"), "full_name", "position", "status", "rookie_year", F.lit("season_or_week_batch").alias("timestamp_quality"))
    return out
