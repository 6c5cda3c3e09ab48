"""Time arithmetic. The session time zone should be UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1000000


def days_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 86400


def latest(df: DataFrame, column: Column, as_of: datetime | Column | None) -> Column:
    """``as_of`` if given, else the greatest ``column`` value in ``df``.

    The default is a scalar subquery, so the reference moment is computed once
    by Spark and needs neither a join nor a driver round trip.
    """
    if as_of is None:
        return df.agg(F.max(column)).scalar()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
