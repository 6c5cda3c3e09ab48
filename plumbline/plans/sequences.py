"""Ordered sequences that may be too long for one task.

A sequence is the rows of one key in a given order. Short ones are sorted by a window over
their key. A window would also sort a hot key in a single task, so sequences of more than
``LONGEST`` rows are found by a count first, dealt out by ranges of (key, order) and
written: a range is then a block of its sequence. A caller who knows an expression that
never decreases along the order, such as the hour of a timestamp, can name it as ``block``
and save the count and the ranges. Either way rows are sorted per (key, block), and only
one summary row per block is carried across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.scratch import written

#: Rows of one sequence that a task sorts in one piece.
LONGEST = 1_000_000
_NOT_IN_ORDER = "The block expression decreases along the order."


def split_long(
    rows: DataFrame, order: Sequence[str], longest: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of short sequences, rows of longer ones with a ``_block``, None without any).

    ``rows`` has the sequence's key as ``_key``. Keys are counted by an aggregate that runs
    here; there are at most so many long ones as ``longest`` goes into the rows.
    """
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    keys = counts.filter(F.col("_n") > (LONGEST if longest is None else longest)).select("_key")
    if keys.isEmpty():
        return rows, None
    keys = written(keys, "long-keys")
    ranged = (
        rows.join(keys, "_key", "left_semi").repartitionByRange("_key", *order)
        .withColumn("_block", F.struct(F.spark_partition_id().alias("block")))
    )
    # Ranges come from a sample: written, they are the same for all that reads them.
    return rows.join(keys, "_key", "left_anti"), written(ranged, "ranges")


def _before_block(name: str, combine: str) -> Column:
    """An aggregate of ``name`` over the earlier blocks of the same sequence."""
    earlier = (
        Window.partitionBy("_key")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = F.call_function(combine, F.col(name)).over(earlier)
    return F.coalesce(carried, F.lit(0))


def _join_blocks(rows: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """Add per-block columns to rows; both stay partitioned by key and block."""
    side = blocks.select(
        F.col("_key").alias("_block_key"), F.col("_block").alias("_block_id"), *columns
    )
    same = (F.col("_key") == F.col("_block_key")) & (F.col("_block") == F.col("_block_id"))
    return rows.join(side, same).drop("_block_key", "_block_id")


def _checked(order: Column, first: str, last: str, before: Column) -> Column:
    """``order`` of blocks as it is, but an error if one begins before the last one ends."""
    return F.when(F.col(first) < before, F.raise_error(F.lit(_NOT_IN_ORDER))).otherwise(order)


def _hashed(rows: DataFrame) -> DataFrame:
    """Two independent hashes of each element's position and value."""
    return rows.withColumns(
        {
            "own1": F.xxhash64(F.lit(1), "pos", "_value"),
            "own2": F.xxhash64(F.lit(2), "pos", "_value"),
        }
    )


def _ordered(sequence: Sequence[str], rows: DataFrame) -> Window:
    orders = [name for name in rows.columns if name.startswith("_order")]
    return Window.partitionBy(*sequence).orderBy(*orders)


def _before(name: str, window: Window) -> Column:
    """XOR of ``name`` over the elements before this one in its window."""
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.bit_xor(name).over(earlier), F.lit(0))


def _totals() -> tuple[Column, ...]:
    return (
        F.count(F.lit(1)).alias("length"),
        F.bit_xor("own1").alias("fp1"),
        F.bit_xor("own2").alias("fp2"),
    )


def _in_one_piece(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes and wholes with one sort per sequence."""
    window = _ordered(["_key"], rows)
    elements = _hashed(
        rows.withColumn("pos", F.row_number().over(window).cast("long"))
    )
    prefixes = elements.select(
        "_key", "pos", *[_before(f"own{i}", window).alias(f"fp{i}") for i in (1, 2)]
    )
    return prefixes, elements.groupBy("_key").agg(*_totals())


def _in_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with one sort per block; block totals carry over to later blocks."""
    window = _ordered(["_key", "_block"], rows)
    order = F.struct(*[name for name in rows.columns if name.startswith("_order")])
    counts = rows.groupBy("_key", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"), F.max(order).alias("_last")
    )
    ended = F.lag("_last").over(Window.partitionBy("_key").orderBy("_block"))
    counts = counts.withColumn(
        "_skipped", _checked(_before_block("n", "sum"), "_first", "_last", ended)
    )
    local = rows.withColumn("pos", F.row_number().over(window).cast("long"))
    elements = _hashed(
        _join_blocks(local, counts, "_skipped").withColumn(
            "pos", F.col("pos") + F.col("_skipped")
        )
    )
    blocks = elements.groupBy("_key", "_block").agg(*_totals())
    carried = blocks.withColumns(
        {f"_carry{i}": _before_block(f"fp{i}", "bit_xor") for i in (1, 2)}
    )
    inside = elements.select(
        "_key", "_block", "pos",
        *[_before(f"own{i}", window).alias(f"_in{i}") for i in (1, 2)],
    )
    prefixes = _join_blocks(inside, carried, "_carry1", "_carry2").select(
        "_key",
        "pos",
        *[
            F.col(f"_in{i}").bitwiseXOR(F.col(f"_carry{i}")).alias(f"fp{i}")
            for i in (1, 2)
        ],
    )
    wholes = blocks.groupBy("_key").agg(
        F.sum("length").alias("length"),
        F.bit_xor("fp1").alias("fp1"),
        F.bit_xor("fp2").alias("fp2"),
    )
    return prefixes, wholes


def prefix_fingerprints(
    items: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    block: Column | None = None,
    longest: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all strict prefixes and of all whole sequences.

    The first frame is (keys, length, fp1, fp2), one row per element but the
    first: the sequence's prefix that ends just before it. The second has the same
    columns, one row per sequence. Two sequences of one length have the same
    (fp1, fp2) if they hold the same values, and otherwise with probability
    2**-128.

    With a ``block``, all sequences are sorted block by block; a block that does not follow
    the order raises. Without it those of more than ``longest`` rows (``LONGEST`` if not
    given) are sorted range by range, which takes jobs while this is called; the result is
    the same for every ``longest``.

    A fingerprint is the XOR of hashes of (position, value). Keys and blocks travel
    as structs: equal structs compare null-safely, a null block sorts first as a
    null order does, and windows, aggregates and joins share one shuffle.
    """
    rows = items.select(
        F.struct(*keys).alias("_key"),
        *[F.col(name).alias(f"_order{i}") for i, name in enumerate(order)],
        value.alias("_value"),
        *([] if block is None else [F.struct(block.alias("block")).alias("_block")]),
    )
    if block is not None:
        prefixes, wholes = _in_blocks(rows)
    else:
        names = [name for name in rows.columns if name.startswith("_order")]
        short, long = split_long(rows, names, longest)
        prefixes, wholes = _in_one_piece(short)
        if long is not None:
            more, ends = _in_blocks(long)
            prefixes, wholes = prefixes.unionByName(more), wholes.unionByName(ends)

    def unpacked(df: DataFrame, length: Column) -> DataFrame:
        names = [F.col(f"_key.{name}").alias(name) for name in keys]
        return df.select(*names, length.alias("length"), "fp1", "fp2")

    strict = prefixes.filter(F.col("pos") > 1)
    return unpacked(strict, F.col("pos") - 1), unpacked(wholes, F.col("length"))


def out_of_order_counts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    block: Column | None = None,
    longest: int | None = None,
) -> DataFrame:
    """(keys, rows, out_of_order): rows whose value is below the one before it.

    ``block`` and ``longest`` as in ``prefix_fingerprints``.
    """
    rows = df.select(
        F.struct(*keys).alias("_key"),
        F.struct(*order).alias("_order"),
        F.col(value).alias("_value"),
        *([] if block is None else [F.struct(block.alias("block")).alias("_block")]),
    )
    if block is not None:
        counted = _steps_in_blocks(rows)
    else:
        short, long = split_long(rows, ["_order"], longest)
        counted = _steps_in_one_piece(short)
        if long is not None:
            counted = counted.unionByName(_steps_in_blocks(long))
    names = [F.col(f"_key.{name}").alias(name) for name in keys]
    return counted.select(*names, "rows", "out_of_order")


def _steps_in_one_piece(rows: DataFrame) -> DataFrame:
    within = Window.partitionBy("_key").orderBy("_order")
    steps = rows.withColumn("_previous", F.lag("_value").over(within))
    return steps.groupBy("_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_value") < F.col("_previous")).alias("out_of_order"),
    )


def _steps_in_blocks(rows: DataFrame) -> DataFrame:
    within = Window.partitionBy("_key", "_block").orderBy("_order")
    steps = rows.withColumn("_previous", F.lag("_value").over(within))
    per_block = steps.groupBy("_key", "_block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_value") < F.col("_previous")).alias("inside"),
        F.min_by("_value", "_order").alias("_first"),
        F.max_by("_value", "_order").alias("_last"),
        F.min("_order").alias("_begins"),
        F.max("_order").alias("_ends"),
    )
    across = Window.partitionBy("_key").orderBy("_block")
    joints = per_block.withColumns(
        {
            "rows": _checked(F.col("rows"), "_begins", "_ends", F.lag("_ends").over(across)),
            "_before": F.lag("_last").over(across),
        }
    )
    return joints.groupBy("_key").agg(
        F.sum("rows").alias("rows"),
        (F.sum("inside") + F.count_if(F.col("_first") < F.col("_before"))).alias("out_of_order"),
    )
