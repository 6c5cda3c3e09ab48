"""Argument checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def limited(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of an ordered frame, all with None; the caller's number holds."""
    if n is None:
        return df
    if n < 1:
        raise ValueError("The number of rows must be at least 1.")
    return df.limit(n)


def key_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner"
) -> DataFrame:
    """Join on one key each, which may have the same name.

    The left key stays; the right one stays too if its name is not a left column.
    """
    renamed = right.withColumnRenamed(right_key, "_right_key")
    joined = left.join(renamed, named_column(left_key) == F.col("_right_key"), how)
    if right_key.lower() in {name.lower() for name in left.columns}:
        return joined.drop("_right_key")
    return joined.withColumnRenamed("_right_key", right_key)


def named_column(name: str) -> Column:
    """The column called ``name``, even when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The frame's own spelling of ``names``; an unknown or missing name raises."""
    wanted = list(names)
    if not wanted:
        raise ValueError("No columns specified.")
    known = {column.lower(): column for column in df.columns}
    unknown = [name for name in wanted if name.lower() not in known]
    if unknown:
        raise ValueError(
            f"Column(s) not found: {', '.join(unknown)}. "
            f"Available: {', '.join(df.columns)}"
        )
    return [known[name.lower()] for name in wanted]
