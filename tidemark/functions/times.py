"""When facts become usable: weekly boundaries, zones, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import as_column as _c


def boundary_after(day: Column | str, weekday: str = "TU", hour: int = 12) -> Column:
    """FN-20. The first such weekday and hour strictly after a date: when its facts become usable."""
    return F.next_day(_c(day), weekday).cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))


def boundary_before(day: Column | str, weekday: str = "TU", hour: int = 12) -> Column:
    """FN-20. The last such weekday and hour strictly before a date: the cutoff of predictions for it."""
    return F.next_day(F.date_sub(_c(day), 8), weekday).cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))


def weekly_availability(events: DataFrame, block: list[str], day: str, weekday: str = "TU", hour: int = 12) -> DataFrame:
    """FN-21. Each block's first and last day, as_of (before the first), available_at (after the last) and a quality string.

    Quality is COMPLETE, or the reasons joined by `;`: rows without a day, blocks that span more than a week.
    """
    out = events.groupBy(*block).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(F.col(day).isNull()).alias("n_undated"))
    long = F.datediff("last_day", "first_day") > 6
    flags = F.concat_ws(";", F.when(F.col("n_undated") > 0, "UNDATED_ROWS"), F.when(long, "LONGER_THAN_A_WEEK"))
    return out.select(*block, "first_day", "last_day", boundary_before("first_day", weekday, hour).alias("as_of"), boundary_after("last_day", weekday, hour).alias("available_at"), F.when(flags == "", "COMPLETE").otherwise(flags).alias("quality"))


def local_to_utc(day: Column | str, clock: Column | str, zone: str = "America/New_York") -> Column:
    """FN-22. A local date and `HH:mm` as a UTC timestamp, summer time observed; null if either cannot be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", _c(day).cast("string"), _c(clock)), F.lit("yyyy-MM-dd H:mm")), zone)


def strict_timestamp(text: Column | str) -> Column:
    """FN-23. A timestamp from text that names its zone (Z or an offset); text without one is null."""
    zoned = _c(text).rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.try_to_timestamp(F.regexp_replace(_c(text), r"([+-]\d\d)(\d\d)$", "$1:$2")))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """FN-24. With fractions; negative if the end is earlier."""
    micros = lambda x: F.unix_micros(_c(x).cast("timestamp"))
    return (micros(end) - micros(start)) / 60e6
