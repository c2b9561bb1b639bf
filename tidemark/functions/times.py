"""Clocks: seconds at the edges, whole microseconds inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(seconds: Column) -> Column:
    """Seconds (double) as whole microseconds, halves away from zero."""
    return F.round(seconds * MICROS).cast("long")


def seconds(us: Column) -> Column:
    return us / F.lit(float(MICROS))


def timestamp_micros(ts: Column) -> Column:
    """A timestamp with or without zone as microseconds since 1970, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def whole(x: float) -> int:
    """A setting in seconds as microseconds."""
    return round(x * MICROS)
