"""Clock arithmetic on UTC timestamps, exact to the microsecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc(c: Column | str) -> Column:
    """Naive values are read as UTC (the session zone is UTC); zoned values are kept."""
    return col(c).cast("timestamp")


def micros(c: Column | str) -> Column:
    return F.unix_micros(col(c))


def plus_seconds(c: Column | str, seconds: Column | float | int) -> Column:
    """Timestamp plus seconds, computed in whole microseconds."""
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(micros(c) + (s.cast("double") * F.lit(1e6)).cast("bigint"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def time_bucket(c: Column | str, width_s: int) -> Column:
    """Index of the fixed-width bucket that holds the instant."""
    return F.floor(micros(c) / F.lit(int(width_s) * 1000000)).cast("bigint")


def bucket_start(bucket: Column | str, width_s: int) -> Column:
    return F.timestamp_micros(col(bucket) * F.lit(int(width_s) * 1000000))


def stamp(c: Column | str) -> Column:
    """Fixed text form with microseconds, used at table edges that need plain text."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
