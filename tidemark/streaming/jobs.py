"""Streams over landed snapshots and events: ingest, change ledgers, staleness, block sums, online ratings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tidemark.functions.odds import Rating
from tidemark.models.ratings import League
from tidemark.operators import snapshots
from tidemark.sources import sinks
from tidemark.sources.readers import SNAPSHOT, unfolded


def quote_stream(spark: SparkSession, path: str) -> DataFrame:
    """STR-01. New snapshot files as one row an outcome, by the same expressions as the batch reader."""
    return unfolded(spark.readStream.schema(SNAPSHOT).option("multiLine", "true").json(path).select("*", F.col("_metadata.file_path").alias("file")))


def block_sums(events: DataFrame, time: str, key: list[str], value: str, late: str = "1 day") -> DataFrame:
    """STR-05, STR-06. Sums by key and week, weeks turning on Tuesday 12:00 UTC; facts later than the watermark are left out.

    The epoch's day is a Thursday, so weeks start five and a half days on.
    """
    week = F.window(time, "7 days", "7 days", "5 days 12 hours")
    return events.withWatermark(time, late).groupBy(week.alias("week"), *key).agg(F.sum(value).alias("num"), F.count(value).alias("n")).select(F.col("week.start").alias("as_of"), F.col("week.end").alias("available_at"), *key, "num", "n")


def usable(facts: DataFrame, available: str, cutoff: str) -> DataFrame:
    """STR-05. Facts by whether they count for a cutoff; a late fact keeps its own availability and is never dated back."""
    return facts.withColumn("usable", F.coalesce(F.col(available) <= F.col(cutoff), F.lit(False)))


def reliability_windows(attempts: DataFrame, time: str, source: str, outcome: str, length: str = "1 day", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """STR-08. Attempts and successes of each source over a sliding window."""
    w = F.window(time, length, slide)
    return attempts.withWatermark(time, late).groupBy(w.alias("w"), source).agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(F.col(outcome) == "success").alias("n_success")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), source, "n_attempts", "n_success")


def commit_once(stream: DataFrame, path: str, schema: T.StructType, key: str, checkpoint: str) -> StreamingQuery:
    """STR-03. Each snapshot reaches the ledger once and whole, though it comes again or batches repeat."""
    return stream.writeStream.foreachBatch(lambda df, batch: sinks.append_once(df, path, schema, key, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changed(fields: list[str]):
    """STR-02. The last records of a share of the keys as one state; records of a batch are taken in the order of their time, late and repeated ones left out."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: dict[str | None, list] = {name: kept for name, *kept in json.loads(state.get[0])} if state.exists else {}
        pdf = pd.concat(list(pdfs)).sort_values("at", kind="stable")
        times = [None if pd.isna(t) else t for t in pdf["at"]]
        columns = [[None if pd.isna(v) else str(v) for v in pdf[f]] for f in fields]
        out: list[tuple] = []
        for name, at, *now in zip((None if pd.isna(k) else k for k in pdf["key"]), times, *columns, strict=True):
            old, ns = last.get(name), None if at is None else at.value
            if old is None:
                out.append((name, at, None, None, None, "first_seen"))
            elif ns is not None and old[0] is not None and ns <= old[0]:
                continue
            else:
                for f, x, y in zip(fields, old[1:], now, strict=True):
                    if x != y:
                        out.append((name, at, f, x, y, "populated" if x is None else "cleared" if y is None else "changed"))
            last[name] = [ns, *now]
        state.update((json.dumps([[name, *kept] for name, kept in last.items()]),))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "field", "old", "new", "change_type"])

    return fold


def change_stream(records: DataFrame, fields: list[str], shares: int = 1024) -> DataFrame:
    """STR-02. records (key string, at timestamp, fields as strings) as a stream of changes.

    One key's state cannot see its absence: keys that a snapshot drops are found by commit_changes. Keys are dealt to
    `shares` states, whose number stays as it is for a checkpoint; a state and a call for each key cost milliseconds.
    """
    schema = "key string, at timestamp, field string, old string, new string, change_type string"
    shared = records.select(F.pmod(F.xxhash64("key"), F.lit(shares)).alias("_share"), "key", "at", *fields)
    return shared.groupBy("_share").applyInPandasWithState(_changed(fields), schema, "changes string", "append", "NoTimeout")


def commit_changes(stream: DataFrame, path: str, key: str, snapshot: str, fields: list[str], checkpoint: str) -> StreamingQuery:
    """STR-02. Whole snapshots as they come in: the ledger of each one's changes against the one before, dropped keys included.

    A batch holds whole snapshots, later ones than the batches before. Its changes and its last snapshot are written
    to folders of their own, which a repeated batch writes anew; the driver loops over the batch's snapshots, each
    step compares two of them by a join.
    """
    state = f"{path.rstrip('/')}-last"

    def write(df: DataFrame, batch: int) -> None:
        spark, before = df.sparkSession, None
        df = df.select(key, snapshot, *fields).persist()
        times = [r[0] for r in df.select(snapshot).distinct().orderBy(snapshot).collect()]
        if not times:
            df.unpersist()
            return
        if sinks.exists(spark, state):
            kept = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(state).where(F.col("batch") < batch)
            latest = kept.agg(F.max("batch")).first()[0]
            before = None if latest is None else kept.where(F.col("batch") == latest).select(key, *fields)
        out = []
        for t in times:
            after = df.where(F.col(snapshot) == t).select(key, *fields)
            found = snapshots.changes(after if before is None else before, after, key, fields, first=before is None)
            out.append(found.withColumn(snapshot, F.lit(t)))
            before = after
        reduce(DataFrame.unionByName, out).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
        df.where(F.col(snapshot) == times[-1]).write.mode("overwrite").parquet(f"{state}/batch={batch}")
        df.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ALARMS = "source string, last_success timestamp, state string"


class StalenessProcessor(StatefulProcessor):
    """STR-04. Sets a timer at each success and raises an alarm when it runs out without another.

    By event time the timer runs out when the watermark passes the last success and the limit, and a success that
    comes later than that raises the alarm itself, so that a replay gives the same alarms however its rows are batched.
    """

    def __init__(self, limit_ms: int, event_time: bool = False):
        self.limit, self.event_time = limit_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, alarmed boolean")

    def _alarm(self, key: Any, times: list) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]] * len(times), "last_success": times, "state": ["STALE_LAST_SUCCESS"] * len(times)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, alarmed = self.last.get() if self.last.exists() else (None, False)
        missed = []
        for t in sorted(pd.Timestamp(x) for p in rows for x in p["at"]):
            if self.event_time and at is not None and not alarmed and t - pd.Timestamp(at) > pd.Timedelta(milliseconds=self.limit):
                missed.append(at)
            if at is None or t > pd.Timestamp(at):
                at, alarmed = t.to_pydatetime(), False
        self.last.update((at, alarmed))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not alarmed:
            now = int(pd.Timestamp(at).timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.limit)
        return iter([self._alarm(key, missed)] if missed else [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, _ = self.last.get()
        self.last.update((at, True))
        yield self._alarm(key, [at])

    def close(self) -> None:
        pass


def staleness_stream(successes: DataFrame, limit_ms: int, late: str | None = None) -> DataFrame:
    """STR-04. successes (source string, at timestamp) as a stream of alarms: source, the last success, state.

    By processing time; or, if `late` is given, by event time under a watermark of that delay: one alarm for each success
    that none follows within the limit, once the watermark or a later success is beyond it. Null sources are a source,
    rows without a time are ignored.
    """
    known = successes.select("source", "at").where("at is not null")
    if late is not None:
        known = known.withWatermark("at", late)
    return known.groupBy("source").transformWithStateInPandas(StalenessProcessor(limit_ms, late is not None), _ALARMS, "append", "ProcessingTime" if late is None else "EventTime")


_GAME = ["league", "block_ord", "game", "home", "away", "home_score", "away_score", "season", "neutral", "post", "home_adjustment", "away_adjustment"]
_RATINGS = "league string, game string, home string, away string, p_home double, change double"


def _kept(text: str | None, config: Rating) -> dict[str | None, League]:
    leagues: dict[str | None, League] = {}
    for name, season, known in json.loads(text) if text is not None else []:
        leagues[name] = League(config)
        leagues[name].season, leagues[name].ratings = season, known
    return leagues


def _as_text(leagues: dict[str | None, League]) -> str:
    return json.dumps([[name, x.season, x.ratings] for name, x in leagues.items()])


def _played(leagues: dict[str | None, League], pdfs: Iterator[pd.DataFrame], config: Rating) -> pd.DataFrame:
    """Plays a batch's games of a share's leagues in order, a block's all from the ratings before it."""
    games: list[tuple] = []
    for pdf in pdfs:
        games += zip(*(pdf[c].tolist() for c in _GAME), strict=True)
    out = []
    games.sort(key=lambda g: (g[0] is not None, g[0] or "", g[1], g[2]))
    for name, block, game, home, away, hs, aw, season, neutral, post, ha, aa in games:
        league = leagues.get(name)
        if league is None:
            league = leagues[name] = League(config)
        if block != league.block:
            league.begin(block, int(season))
        margin = hs - aw
        _, _, p, _, d = league.play(home, away, None if pd.isna(margin) else margin, neutral, ha - aa, post)
        out.append((name, game, home, away, p, d))
    for league in leagues.values():
        league.settle()
    return pd.DataFrame(out, columns=["league", "game", "home", "away", "p_home", "change"])


def _rated(config: Rating):
    """STR-07. The ratings of a share of the leagues as one state.

    A state and a call for each league cost some 8 ms a league and batch, so leagues share them.
    """

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        leagues = _kept(state.get[0] if state.exists else None, config)
        out = _played(leagues, pdfs, config)
        state.update((_as_text(leagues),))
        yield out

    return fold


class RatingProcessor(StatefulProcessor):
    """STR-07. The same with ratings to begin with, which the first batch takes up."""

    def __init__(self, config: Rating):
        self.c = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("leagues", "leagues string")

    def _leagues(self) -> dict[str | None, League]:
        return _kept(self.kept.get()[0] if self.kept.exists() else None, self.c)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        # a share's rows may come in several calls
        leagues = self._leagues()
        for name, entity, rating, season in zip(*(initialState[c].tolist() for c in ("league", "entity", "rating", "season")), strict=True):
            league = leagues.get(name)
            if league is None:
                league = leagues[name] = League(self.c)
            league.ratings[entity] = rating
            if not pd.isna(season):
                league.season = int(season) if league.season is None else max(league.season, int(season))
        self.kept.update((_as_text(leagues),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        leagues = self._leagues()
        out = _played(leagues, rows, self.c)
        self.kept.update((_as_text(leagues),))
        yield out

    def close(self) -> None:
        pass


def rating_stream(games: DataFrame, config: Rating = Rating(), state: DataFrame | None = None, shares: int = 1024) -> DataFrame:
    """STR-07. games (league, block_ord, game, home, away, home_score, away_score), blocks in order between batches, as predictions and changes.

    state: league, entity, rating and season to begin with, as ratings.rating_state makes them of a stored ledger, so that
    a stream goes on where a batch fold ended; it is read once, by the stream's first batch, and asks for the RocksDB
    state store. season, neutral, post, home_adjustment and away_adjustment count as in the batch fold, if games has them; without,
    there is one season, no neutral site and no adjustment. Null scores are games to come. Leagues are dealt to `shares`
    states, whose number stays as it is for a checkpoint.
    """
    given = {"season": F.lit(0), "neutral": F.lit(False), "post": F.lit(False), "home_adjustment": F.lit(0.0), "away_adjustment": F.lit(0.0)}
    extra = [F.coalesce(F.col(c), v).alias(c) if c in games.columns else v.alias(c) for c, v in given.items()]
    cols = ["league", "block_ord", "game", "home", "away", *(F.col(c).cast("double").alias(c) for c in ("home_score", "away_score"))]
    share = F.pmod(F.xxhash64("league"), F.lit(shares)).alias("_share")
    shared = games.select(share, *cols, *extra).groupBy("_share")
    if state is None:
        return shared.applyInPandasWithState(_rated(config), _RATINGS, "leagues string", "append", "NoTimeout")
    known = state.select(share, "league", "entity", F.col("rating").cast("double").alias("rating"), F.col("season").cast("int").alias("season")).groupBy("_share")
    return shared.transformWithStateInPandas(RatingProcessor(config), _RATINGS, "append", "None", known)
