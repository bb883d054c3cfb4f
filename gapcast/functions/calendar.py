"""Calendar features of an epoch-millisecond column.

Everything is computed on ``timestamp_ntz`` in a named zone, so the result does
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.schema import TIMESTAMP

# The derived columns, in order, and the hours per bucket.
CALENDAR_COLUMNS = ("month", "day", "hour_range")
HOURS_PER_RANGE = 3


def ms_to_seconds(ms: Column) -> Column:
    """Whole seconds, truncated toward zero."""
    return (ms / 1000).cast("long")


def local_time(seconds: Column, tz: str = "UTC") -> Column:
    """Wall-clock time in ``tz`` as ``timestamp_ntz``."""
    utc = F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def format_epoch(seconds: Column, tz: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of an epoch in seconds."""
    return local_time(seconds, tz).cast("string")


def parse_timestamp(text: Column) -> Column:
    """The inverse of :func:`format_epoch`; null where the text is not a time."""
    return text.try_cast("timestamp_ntz")


def hour_range(hour: Column, as_int: bool = False) -> Column:
    """Eight three-hour buckets, 0 to 7."""
    bucket = F.floor(hour / HOURS_PER_RANGE)
    return bucket.cast("int") if as_int else bucket


def calendar_columns(ms: Column, tz: str = "UTC", as_int: bool = False) -> dict[str, Column]:
    """Month, day of month and three-hour bucket, keyed by column name."""
    at = local_time(ms_to_seconds(ms), tz)
    parts = (F.month(at), F.dayofmonth(at), hour_range(F.hour(at), as_int))
    return dict(zip(CALENDAR_COLUMNS, parts))


def calendar_features(
    df: DataFrame, timestamp: str = TIMESTAMP, tz: str = "UTC", as_int: bool = False
) -> DataFrame:
    """Replace the epoch column by its calendar columns, placed last.

    One projection; it works on batch and streaming frames alike.
    """
    return df.withColumns(calendar_columns(F.col(timestamp), tz, as_int)).drop(timestamp)


def epoch_millis(at: Column) -> Column:
    """Milliseconds since 1970 of a ``timestamp_ntz`` taken as UTC, truncated."""
    days = F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(at)) * 3600 + F.minute(at) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), at) * 1000).cast("long")
