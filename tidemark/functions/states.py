"""Classifiers: ordered rules as one `when` chain each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import as_column as _c
from tidemark.functions.text import to_long

#: FN-29. Tokens by meaning. Fixed values.
OUT = ["out", "ir", "injured reserve", "pup"]
DOUBTFUL = ["doubtful"]
QUESTIONABLE = ["questionable", "probable"]
LIMITED = ["limited", "lp"]
ABSENT = ["dnp", "did not participate"]
OFF_ROSTER = ["inactive", "pup", "non-football injury", "nfi", "suspended", "reserve", "retired"]


def evidence_state(injury: Column | str, practice: Column | str, roster: Column | str, order: Column | str) -> Column:
    """FN-29. What a depth-chart record says of an entity; signals that contradict one another are AMBIGUOUS first of all."""
    low = lambda x: F.lower(F.trim(_c(x).cast("string")))
    has = lambda x, tokens: F.coalesce(low(x).isin(tokens), F.lit(False))
    rank = to_long(order)
    first = F.coalesce(rank == 1, F.lit(False))
    return (
        F.when((has(roster, OFF_ROSTER) & first) | (has(injury, OUT) & has(practice, ["full"])), "AMBIGUOUS")
        .when(has(injury, OUT), "DEPTH_CHART_EXPECTED_OUT")
        .when(has(injury, DOUBTFUL), "DEPTH_CHART_EXPECTED_DOUBTFUL")
        .when(has(injury, QUESTIONABLE), "DEPTH_CHART_EXPECTED_QUESTIONABLE")
        .when(has(practice, LIMITED), "DEPTH_CHART_EXPECTED_LIMITED")
        .when(has(practice, ABSENT), "DEPTH_CHART_EXPECTED_QUESTIONABLE")
        .when(rank.isNull(), "UNKNOWN")
        .when(first, "DEPTH_CHART_EXPECTED_HEALTHY")
        .otherwise("BACKUP_CANDIDATE")
    )


def missing_fields(present: Column | str, expected: list[str]) -> Column:
    """FN-30. The expected fields that a payload lacks; further fields are no drift."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, expected)), _c(present)))


def freshness_state(reached: Column | str, last_success: Column | str, present: Column | str, expected: list[str], changes: Column | str, now: Column | str, limit_seconds: float) -> Column:
    """FN-30. Transport failures before parse failures before schema drift before age."""
    age = (F.unix_micros(_c(now)) - F.unix_micros(_c(last_success))) / 1e6
    return (
        F.when(~F.coalesce(_c(reached), F.lit(False)) | _c(last_success).isNull(), "FETCH_FAILED_USING_NO_FALLBACK")
        .when(F.coalesce(F.size(_c(present)), F.lit(0)) <= 0, "INCOMPLETE_RESPONSE")
        .when(F.size(missing_fields(present, expected)) > 0, "SCHEMA_DRIFT")
        .when(age > limit_seconds, "STALE_LAST_SUCCESS")
        .when(_c(changes) > 0, "FRESH_FETCH_CHANGED")
        .otherwise("FRESH_FETCH_NO_CHANGE")
    )


def half_of_period(period: Column | str) -> Column:
    """FN-32. Periods 1 and 2 are half 1, 3 and 4 half 2, 5 overtime (3); others are an error."""
    p = _c(period)
    return F.when(p.isNull(), F.lit(None).cast("int")).when(p.isin(1, 2), 1).when(p.isin(3, 4), 2).when(p == 5, 3).otherwise(F.raise_error(F.concat(F.lit("unknown period: "), p.cast("string"))).cast("int"))


def stage_rank(stage: Column | str, stages: list[str]) -> Column:
    """FN-32. The place of a stage of a season in its order; unknown stages are an error."""
    place = F.array_position(F.array(*map(F.lit, stages)), _c(stage))
    return F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("unknown stage: "), F.coalesce(_c(stage), F.lit("null")))).cast("long")).cast("int")


def attempt_states(attempts: DataFrame, key: str, outcome: str) -> DataFrame:
    """FN-36. One state a request, by precedence: rejected, failed, success, else eligible."""
    seen = lambda x: F.bool_or(F.coalesce(F.col(outcome) == x, F.lit(False)))
    state = F.when(seen("rejected"), "rejected").when(seen("failed"), "failed").when(seen("success"), "success").otherwise("eligible")
    return attempts.groupBy(key).agg(state.alias("state"), F.count(F.lit(1)).alias("n_attempts"))
