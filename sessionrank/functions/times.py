"""Time arithmetic on epoch microseconds: independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

US = 1_000_000
HOUR = 3600
DAY = 24 * HOUR
WEEK = 7 * DAY


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def seconds(ts: str | Column = "ts") -> Column:
    """Whole epoch seconds."""
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


def whole_units(later: Column, earlier: Column, unit_seconds: int = 1) -> Column:
    """Difference of two microsecond columns in whole units, cut towards zero."""
    gap = later - earlier
    whole = F.floor(F.abs(gap) / F.lit(float(unit_seconds * US)))
    return F.when(gap < 0, -whole).otherwise(whole).cast("long")


def hour_start(sec: Column) -> Column:
    """Epoch second at which the hour of ``sec`` starts."""
    return (sec - F.pmod(sec, F.lit(HOUR))).cast("long")


def hour_of_day(sec: Column) -> Column:
    """Fractional hour of day, 0 <= h < 24."""
    return F.pmod(sec, F.lit(DAY)) / F.lit(float(HOUR))


def epoch_dow(sec: Column) -> Column:
    """Day of the week counted from the epoch: 0 is Thursday."""
    return F.floor(F.pmod(sec, F.lit(WEEK)) / F.lit(float(DAY))).cast("long")


def hour_spine(df, start: str, end: str, name: str = "ts_hour"):
    """One row per hour between two timestamp columns, both ends included."""
    return df.select(F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 hour"))).alias(name))
