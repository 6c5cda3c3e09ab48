"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip_text(text: Column, limit: int, keep: int) -> Column:
    """Text longer than ``limit`` characters cut to ``keep`` plus an ellipsis."""
    cut = F.concat(F.substring(text, 1, keep), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """Literal containment; no character of ``needle`` is a wildcard."""
    return F.lower(text).contains(needle.lower())


def line_count(text: Column) -> Column:
    """Number of newline-separated lines; missing or empty text has one."""
    body = F.coalesce(text, F.lit(""))
    newlines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return newlines + 1
