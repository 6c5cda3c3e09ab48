"""Value counts of several columns in one scan and one shuffle.

Each row is unpivoted to (column, value) and counted per value, so a value that
fills a third of the table is combined before the shuffle. Values are numbers,
fractions or texts, each kind in a field of its own, so that 9 and 10 are counted as
numbers. Distinct counts, null counts and the share of the most frequent value all
follow from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.args import named_column

# Texts longer than this are grouped by their SHA-256, so that a shuffle moves
# at most this many characters per value instead of the whole text.
DIGEST_OVER = 64
_DIGEST_MARK = "sha256:"


def digest_key(text: Column) -> Column:
    """Text usable as a grouping key: itself if short, else its digest.

    The prefix makes a digest longer than any short text, so the two kinds of
    key never meet.
    """
    digest = F.concat(F.lit(_DIGEST_MARK), F.sha2(text, 256))
    return F.when(F.length(text) > DIGEST_OVER, digest).otherwise(text)


def is_digest(key: Column) -> Column:
    """Whether a key made by :func:`digest_key` is a digest."""
    return (F.length(key) > DIGEST_OVER) & key.startswith(_DIGEST_MARK)


_FIELDS = {"whole": "bigint", "fraction": "double", "text": "string"}


def _as_key(column: Column, data_type: T.DataType) -> tuple[str, Column]:
    """The field a value is counted in, and the value as it is counted there."""
    if isinstance(data_type, T.IntegralType):
        return "whole", column.cast("bigint")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # Adding zero makes -0.0 and 0.0 the same value, as in SQL DISTINCT.
        return "fraction", column.cast("double") + F.lit(0.0)
    if isinstance(data_type, T.BinaryType):
        return "text", digest_key(F.hex(column))
    return "text", digest_key(column.cast("string"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, whole, fraction, text, n): how often each value occurs, nulls included."""
    cells = []
    for name in columns:
        kind, key = _as_key(named_column(name), df.schema[name].dataType)
        fields = [
            (key if field == kind else F.lit(None)).cast(data_type).alias(field)
            for field, data_type in _FIELDS.items()
        ]
        cells.append(F.struct(F.lit(name).alias("column"), *fields))
    long = df.select(F.inline(F.array(*cells)))
    return long.groupBy("column", *_FIELDS).agg(F.count(F.lit(1)).alias("n"))


#: Values a sketch of frequent items keeps for a column; an estimate is off by at most
#: ``rows * SKETCH_ERROR / TRACKED_VALUES``, and exact while there are fewer values.
TRACKED_VALUES = 10_000
SKETCH_ERROR = 3.5


def _top_count(key: Column) -> Column:
    """About how often the most frequent value occurs, from a mergeable sketch."""
    # Nulls count as a value of their own, so the first two hold the one wanted.
    top = F.call_function("approx_top_k", key, F.lit(2), F.lit(TRACKED_VALUES))
    known = F.filter(top, lambda found: found["item"].isNotNull())
    return F.coalesce(F.get(known, F.lit(0))["count"], F.lit(0))


def _approximate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same measures from one aggregate, distinct values and the top count estimated."""
    row = df.agg(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.count(F.lit(1)).alias("total"),
                F.count_if(named_column(name).isNull()).alias("nulls"),
                F.approx_count_distinct(
                    _as_key(named_column(name), df.schema[name].dataType)[1], 0.01
                ).alias("distinct_count"),
                _top_count(_as_key(named_column(name), df.schema[name].dataType)[1]).alias(
                    "top_count"
                ),
            ).alias(f"_c{i}")
            for i, name in enumerate(columns)
        ]
    )
    return row.select(F.inline(F.array(*row.columns)))


def column_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """(column, total, nulls, distinct_count, top_count), one row per column.

    An empty table still gives its rows, with zeros. ``approx=True`` estimates the
    distinct counts (about 1 % off) and top counts without a shuffle of values.
    """
    if approx:
        return _approximate(df, columns)
    n = F.col("n")
    is_null = F.coalesce(*[F.col(f).cast("string") for f in _FIELDS]).isNull()
    measures = ("total", "nulls", "distinct_count", "top_count")
    # A row of zeros per column keeps columns of an empty table in the result.
    zeros = df.sparkSession.createDataFrame(
        [(name, 0, 0, 0, 0) for name in columns],
        "column string, " + ", ".join(f"{m} bigint" for m in measures),
    )
    counted = value_counts(df, columns).groupBy("column").agg(
        F.sum(n).alias("total"),
        F.sum(F.when(is_null, n).otherwise(0)).alias("nulls"),
        F.count_if(~is_null).alias("distinct_count"),
        F.max(F.when(~is_null, n).otherwise(0)).alias("top_count"),
    )
    both = zeros.unionByName(counted)
    return both.groupBy("column").agg(*[F.sum(m).alias(m) for m in measures])
