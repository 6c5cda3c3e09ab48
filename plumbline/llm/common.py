"""Shared parts of the training-data operators: columns, scratch tables, text slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.args import named_column
from plumbline.functions.shipping import ship_package as send_package
from plumbline.plans.scratch import scratch_path

ROWS_PER_FILE = 250_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark application."""
    # Texts can be very long: fewer rows than by default go to a Python worker at once.
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    send_package(spark)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that no column of the frame has, in any case."""
    taken = {name.lower() for name in df.columns}
    mark = "_"
    while any(f"{mark}{name}".lower() in taken for name in names):
        mark += "_"
    return [f"{mark}{name}" for name in names]


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs no earlier step, and what follows may
    read the table several times. The job runs when this function is called. If about so
    many (small) rows are known to come, they go into no more files than they need.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null texts as empty ones; other columns are left out."""
    ship_package(df.sparkSession)
    return df.select(
        named_column(id_col).alias("id"),
        F.coalesce(named_column(text_col), F.lit("")).alias("text"),
    )


def by_size(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 21
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most ``most`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size + 16
        if start < len(sizes):
            yield batch.slice(start)


def gathered(
    batches: Iterable[pa.RecordBatch], column: str = "text", least: int = 1 << 23
) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``least`` bytes of text, and cut beyond that."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in by_size(batches, column, least):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def packed_planes(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed byte by byte of their places: high bytes are mostly 0."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked_planes(packed: bytes, kind: str | np.dtype) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: bigint), component = least node.

    Alternating star contraction: every round links the larger neighbours of a node to
    its least one, then does the same on the smaller side. Each round is written to the
    shared folder; the count and sum of the edges tell when nothing changes any more.
    Rows stay linear in the edges, also around a node with very many of them.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = written(edges.distinct(), "edges")
    before, rows = None, edges.count()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")
        )
        large = (
            both.join(least, "a")
            .filter((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (
            small.select("a", F.col("m").alias("b"))
            .unionByName(
                small.filter(F.col("b") != F.col("m")).select(
                    F.col("b").alias("a"), F.col("m").alias("b")
                )
            )
            .distinct()
        )
        edges = written(small, "edges", rows)
        now = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if now == before:
            break
        before, rows = now, now["n"]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.distinct()
    )
