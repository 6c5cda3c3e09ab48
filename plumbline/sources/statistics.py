"""Answers from the statistics in Parquet footers, without reading a column."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.args import named_column, require_columns

# Types whose footers hold exact bounds; those of texts may be cut short.
_BOUNDED = (T.IntegralType, T.DateType)


@contextmanager
def pushed_aggregates(spark: SparkSession) -> Iterator[None]:
    """Spark's newer Parquet reader with aggregates pushed to it, for what is planned inside."""
    wanted = {
        "spark.sql.sources.useV1SourceList": "",
        "spark.sql.parquet.aggregatePushdown": "true",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def footer_aggregate(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row: ``rows``, and for column n of ``columns`` its ``min<n>`` and ``max<n>``.

    Plan and run it inside ``pushed_aggregates``. Columns must be whole numbers or dates.
    """
    table = spark.read.parquet(path)
    names = require_columns(table, columns) if columns else []
    for name in names:
        if not isinstance(table.schema[name].dataType, _BOUNDED):
            raise ValueError(f"Footers hold no exact bounds of column '{name}'.")
    bounds = [
        bound(named_column(name)).alias(f"{label}{n}")
        for n, name in enumerate(names) for label, bound in (("min", F.min), ("max", F.max))
    ]
    return table.agg(F.count(F.lit(1)).alias("rows"), *bounds)


def inventory_from_footers(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count, column_count) of Parquet tables, as ``table_inventory``."""
    rows = []
    with pushed_aggregates(spark):
        for name, path in paths.items():
            count = footer_aggregate(spark, path).first()["rows"] or 0  # null without a row
            rows.append((name, count, len(spark.read.parquet(path).columns)))
    return spark.createDataFrame(
        rows, "table_name string, row_count bigint, column_count int"
    ).orderBy("table_name")


def bounds_from_footers(
    spark: SparkSession, columns: Sequence[tuple[str, str]]
) -> DataFrame:
    """(path, column, row_count, min_value, max_value) of whole-number columns of tables.

    ``columns`` are (path, column) pairs; each table's footers are read once for all.
    """
    by_path: dict[str, list[str]] = {}
    for path, column in columns:
        by_path.setdefault(path, []).append(column)
    rows = []
    with pushed_aggregates(spark):
        for path, names in by_path.items():
            found = footer_aggregate(spark, path, names).first()
            rows += [(path, name, found["rows"] or 0, found[f"min{n}"], found[f"max{n}"])
                     for n, name in enumerate(names)]
    return spark.createDataFrame(
        rows, "path string, column string, row_count bigint, min_value bigint, max_value bigint"
    )
