"""Parquet files laid out so that a lookup reads few of their row groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.functions.args import named_column, require_columns


def write_lookup_files(
    df: DataFrame,
    path: str,
    sort_by: str,
    bloom: Sequence[str] = (),
    row_group_bytes: int = 16 << 20,
    values_per_file: int = 1_000_000,
) -> None:
    """Write rows in ranges of ``sort_by``, with Bloom filters on the ``bloom`` columns.

    Files hold ranges and are sorted, so the bounds of a row group tell whether a value of
    ``sort_by`` can be in it; for the other columns its Bloom filter does. Both are looked at
    by Spark's own reader when a filter compares the bare column, as ``lookup_by_name``
    does. ``values_per_file`` is about how many different values a file has, which sets the
    filters' size.
    """
    order, *others = require_columns(df, [sort_by, *bloom])
    writer = df.repartitionByRange(named_column(order)).sortWithinPartitions(named_column(order))
    writer = writer.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    for name in others:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", values_per_file)
    writer.parquet(path)
