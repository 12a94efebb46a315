"""Time arithmetic that several rules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def millis_between(later: Column, earlier: Column) -> Column:
    """Whole milliseconds between two times, each cut to milliseconds first."""
    return F.floor(micros(later) / 1000).cast("long") - F.floor(micros(earlier) / 1000).cast("long")


def whole_hours(later: Column, earlier: Column) -> Column:
    """Hours between two times, truncated; 0 where one is missing."""
    return F.coalesce((millis_between(later, earlier) / 3_600_000).cast("long"), F.lit(0).cast("long"))


def ago(as_of: Column, seconds: int) -> Column:
    """as_of less so many seconds, in as_of's own type."""
    return as_of - F.make_interval(secs=F.lit(float(seconds)))
