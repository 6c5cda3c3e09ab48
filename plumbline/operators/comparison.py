"""Comparison of two key sets, two tables or two versions of a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import line_count
from plumbline.operators.profiling import table_schema_profile


def _side_status(in_a: Column, in_b: Column) -> Column:
    return (
        F.when(in_a & in_b, "both").when(in_a, "only_a").otherwise("only_b")
    )


def set_compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key of either side once, with status only_a, only_b or both.

    Text keys match in any case and are shown in the smallest spelling. Both sides
    go through one aggregate: a key's copies are combined before the shuffle, and
    a null key matches a null key. Spellings are merged after that.
    """
    def side(df: DataFrame, in_a: bool) -> DataFrame:
        return df.select(
            *keys, F.lit(in_a).alias("_a"), F.lit(not in_a).alias("_b")
        )

    matched = [
        (F.lower(k) if isinstance(a.schema[k].dataType, T.StringType) else F.col(k))
        .alias(f"_key_{k}")
        for k in keys
    ]
    sides = [F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b")]
    merged = side(a, True).unionByName(side(b, False)).groupBy(*keys).agg(*sides)
    if any(isinstance(a.schema[k].dataType, T.StringType) for k in keys):
        spelt = [F.min(k).alias(k) for k in keys]
        merged = merged.groupBy(*matched).agg(*spelt, *sides)
    return merged.select(*keys, _side_status(F.col("_a"), F.col("_b")).alias("status"))


def set_compare_counts(comparison: DataFrame) -> DataFrame:
    """(status, keys) over the result of :func:`set_compare`, zeros included."""
    status = F.col("status")
    names = ("only_a", "only_b", "both")
    counted = comparison.agg(*[F.count_if(status == n).alias(n) for n in names])
    return counted.unpivot([], list(names), "status", "keys")


def column_diff(a: DataFrame, b: DataFrame, approx: bool = False) -> DataFrame:
    """Columns of two tables side by side; names match in any case.

    (column, type_1, type_2, nulls_1, nulls_2, ndv_1, ndv_2, status) where status
    is only_1, only_2, type, nullability or same. ``approx=True`` estimates the ndv.
    """
    def side(df: DataFrame, n: int) -> DataFrame:
        return table_schema_profile(df, approx=approx).select(
            F.lower("column").alias(f"_match{n}"),
            F.col("column").alias(f"_column{n}"),
            F.col("type").alias(f"type_{n}"),
            F.col("nullable").alias(f"_nullable{n}"),
            F.col("nulls").alias(f"nulls_{n}"),
            F.col("distinct_count").alias(f"ndv_{n}"),
        )

    joined = side(a, 1).join(
        side(b, 2), F.col("_match1") == F.col("_match2"), "full_outer"
    )
    status = (
        F.when(F.col("_match2").isNull(), "only_1")
        .when(F.col("_match1").isNull(), "only_2")
        .when(F.lower("type_1") != F.lower("type_2"), "type")
        .when(F.col("_nullable1") != F.col("_nullable2"), "nullability")
        .otherwise("same")
    )
    return joined.select(
        F.coalesce("_column1", "_column2").alias("column"),
        "type_1", "type_2", "nulls_1", "nulls_2", "ndv_1", "ndv_2",
        status.alias("status"),
    )


def text_version_tokens(
    a: DataFrame, b: DataFrame, key: str, text_col: str
) -> DataFrame:
    """(key, token, side): the distinct tokens of both versions, only_a, only_b or both.

    The names behind the counts of :func:`text_version_diff`, as one row each. A key with
    a text on one side only has its tokens on that side. Null texts have none.
    """
    def side(df: DataFrame, in_a: bool) -> DataFrame:
        words = F.array_distinct(F.split(F.lower(text_col), r"\s+"))
        return df.select(
            key,
            F.explode(F.array_remove(words, "")).alias("token"),
            F.lit(in_a).alias("_a"),
            F.lit(not in_a).alias("_b"),
        )

    merged = side(a, True).unionByName(side(b, False)).groupBy(key, "token").agg(
        F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b")
    )
    return merged.select(key, "token", _side_status(F.col("_a"), F.col("_b")).alias("side"))


def text_version_diff(
    a: DataFrame, b: DataFrame, key: str, text_col: str
) -> DataFrame:
    """Per key: how two versions of a text differ in lines and tokens.

    (key, in_a, in_b, lines_a, lines_b, diff, longer, tokens_only_a,
    tokens_only_b, tokens_both). A version may come in several rows; their lines
    add up. Tokens are whitespace-separated words in lower case, each counted
    once; as the reports they serve, token counts are null unless both exist.

    Tokens are combined per (key, token) and then per key, so no key's tokens are
    ever gathered in one place. The null token of each row carries its lines.
    """
    def side(df: DataFrame, in_a: bool) -> DataFrame:
        words = F.array_distinct(F.split(F.lower(text_col), r"\s+"))
        tokens = F.array_compact(F.array_remove(words, ""))
        rows = df.filter(F.col(text_col).isNotNull()).select(
            F.col(key),
            line_count(F.col(text_col)).alias("_lines"),
            F.explode_outer(
                F.array_prepend(tokens, F.lit(None).cast("string"))
            ).alias("_token"),
        )
        lines = F.when(F.col("_token").isNull(), F.col("_lines")).otherwise(0)
        return rows.select(
            key,
            "_token",
            (lines if in_a else F.lit(0)).alias("_lines_a"),
            (F.lit(0) if in_a else lines).alias("_lines_b"),
            F.lit(in_a).alias("_a"),
            F.lit(not in_a).alias("_b"),
        )

    per_token = (
        side(a, True).unionByName(side(b, False))
        .groupBy(key, "_token")
        .agg(
            F.sum("_lines_a").alias("_lines_a"),
            F.sum("_lines_b").alias("_lines_b"),
            F.bool_or("_a").alias("_a"),
            F.bool_or("_b").alias("_b"),
        )
    )
    is_token = F.col("_token").isNotNull()
    in_a, in_b = F.col("_a"), F.col("_b")
    per_key = per_token.groupBy(key).agg(
        F.bool_or("_a").alias("in_a"),
        F.bool_or("_b").alias("in_b"),
        F.sum("_lines_a").alias("lines_a"),
        F.sum("_lines_b").alias("lines_b"),
        F.count_if(is_token & in_a & ~in_b).alias("_only_a"),
        F.count_if(is_token & in_b & ~in_a).alias("_only_b"),
        F.count_if(is_token & in_a & in_b).alias("_both"),
    )
    both = F.col("in_a") & F.col("in_b")
    longer = (
        F.when(F.col("lines_a") > F.col("lines_b"), "a")
        .when(F.col("lines_b") > F.col("lines_a"), "b")
        .otherwise("same")
    )
    return per_key.select(
        key,
        "in_a",
        "in_b",
        "lines_a",
        "lines_b",
        F.when(both, F.abs(F.col("lines_a") - F.col("lines_b"))).alias("diff"),
        F.when(both, longer).alias("longer"),
        F.when(both, F.col("_only_a")).alias("tokens_only_a"),
        F.when(both, F.col("_only_b")).alias("tokens_only_b"),
        F.when(both, F.col("_both")).alias("tokens_both"),
    )
