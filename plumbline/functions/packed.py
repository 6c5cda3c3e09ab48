"""Dates, times and durations packed into decimal digits of an integer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def packed_timestamp(date_digits: Column, time_digits: Column) -> Column:
    """``20240131`` and ``93005`` as ``2024-01-31 09:30:05``; null if impossible."""
    day = F.lpad(date_digits.cast("string"), 8, "0")
    clock = F.lpad(time_digits.cast("string"), 6, "0")

    def part(text: Column, start: int, length: int) -> Column:
        return F.substring(text, start, length)

    iso = F.concat(
        F.concat_ws("-", part(day, 1, 4), part(day, 5, 2), part(day, 7, 2)),
        F.lit(" "),
        F.concat_ws(":", part(clock, 1, 2), part(clock, 3, 2), part(clock, 5, 2)),
    )
    return F.when(
        date_digits.isNotNull() & time_digits.isNotNull(),
        iso.try_cast("timestamp_ntz"),
    )


def packed_seconds(duration_digits: Column) -> Column:
    """``HHMMSS`` digits as a number of seconds."""
    digits = duration_digits.cast("long")
    hours = F.floor(digits / 10000)
    minutes = F.floor(digits / 100) % 100
    return (hours * 3600 + minutes * 60 + digits % 100).cast("long")
