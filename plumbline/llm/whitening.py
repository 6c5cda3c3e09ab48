"""Whitening of embeddings by the covariance of their different vectors.

Vectors are turned to integers first, so equal ones can be grouped and sums are exact.
Tasks return one matrix of centred products for each vector length; the driver holds
that matrix, in proportion to the square of the length and never to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import ship_package, written

_LIMIT = 1 << 62


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for every vector length in the batch."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, flat[starts[rows][:, None] + np.arange(size)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they suffice, Python's beyond."""
    largest = int(np.abs(x).max(initial=0))
    if n * largest + max(map(abs, sums), default=0) < _LIMIT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_lengths(d: np.ndarray) -> list[int]:
    """The exact sum of squares of every row."""
    largest = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
    if d.dtype != object and largest**2 * max(d.shape[1], 1) < _LIMIT:
        return (d * d).sum(axis=1).tolist()
    wide = d.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def _exact_sums(different: DataFrame, weight: str) -> dict[int, tuple[int, list[int]]]:
    """{length: (weight of all vectors, weighted sum of every dimension)}."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            weights = batch.column(weight).to_numpy()
            for size, rows, x in _by_length(batch, "x"):
                w = weights[rows]
                if int(np.abs(x).max(initial=0)) * int(w.sum()) >= _LIMIT:
                    x, w = x.astype(object), w.astype(object)
                total = held.setdefault(size, [0, [0] * size])
                total[0] += int(w.sum())
                total[1] = [a + int(b) for a, b in zip(total[1], (x * w[:, None]).sum(axis=0))]
        rows = [(size, dim, n, Decimal(s)) for size, (n, sums) in held.items()
                for dim, s in enumerate(sums)]
        size, dim, n, sums = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(size, pa.int32()), pa.array(dim, pa.int32()), pa.array(n, pa.int64()),
             pa.array(sums, pa.decimal128(38, 0))], ["size", "dim", "n", "s"])

    found = (
        different.select("x", weight)
        .mapInArrow(add, "size int, dim int, n bigint, s decimal(38,0)")
        .groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    made: dict[int, tuple[int, dict[int, int]]] = {}
    for r in found.collect():  # one row for each dimension
        made.setdefault(r["size"], (r["n"], {}))[1][r["dim"]] = int(r["s"])
    return {size: (n, [s[d] for d in range(size)]) for size, (n, s) in made.items()}


def _centred_products(
    frame: DataFrame, column: str, weight: str, centre: Callable[[int, np.ndarray], np.ndarray]
) -> dict[int, np.ndarray]:
    """{length: weighted sum of z z' over all rows, z = centre(length, vector)}.

    Each task multiplies its rows as matrices and gives one row for each line of the
    result; lines are added up in Spark, in the order of the tasks.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            weights = batch.column(weight).to_numpy()
            for size, rows, x in _by_length(batch, column):
                z = centre(size, x)
                product = (z * weights[rows, None]).T @ z
                total = held.setdefault(size, [product.shape[0], 0.0])
                total[1] = total[1] + product
        rows = [(size, line, matrix[line].tobytes()) for size, (width, matrix) in held.items()
                for line in range(width)]
        size, line, cells = zip(*rows) if rows else ((), (), ())
        part = [TaskContext.get().partitionId()] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(size, pa.int32()), pa.array(line, pa.int32()), pa.array(part, pa.int32()),
             pa.array(cells, pa.binary())], ["size", "line", "part", "cells"])

    def add(lines: pd.DataFrame) -> pd.DataFrame:
        ordered = lines.sort_values("part")["cells"]
        total = np.frombuffer(b"".join(ordered), float).reshape(len(ordered), -1).sum(axis=0)
        return lines[["size", "line"]].head(1).assign(cells=total.tobytes())

    found = (
        frame.select(column, weight)
        .mapInArrow(multiply, "size int, line int, part int, cells binary")
        .groupBy("size", "line").applyInPandas(add, "size int, line int, cells binary")
    )
    made: dict[int, dict[int, np.ndarray]] = {}
    for r in found.collect():  # one row for each line of a matrix
        made.setdefault(r["size"], {})[r["line"]] = np.frombuffer(bytes(r["cells"]), float)
    return {size: np.array([m[k] for k in sorted(m)]) for size, m in made.items()}


def principal_components(
    covariance: np.ndarray, components: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, projection, explained) of the leading components.

    A column of the projection is a unit eigenvector over the root of its eigenvalue, its
    largest entry positive. Where an eigenvalue is no more than rounding, it is NaN.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values = values[::-1][:components]
    vectors = vectors[:, ::-1][:, :components]
    lead = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    rounding = max(trace, 0.0) * covariance.shape[0] * np.finfo(float).eps
    safe = np.where(values > rounding, values, np.nan)
    explained = np.maximum(values, 0) / trace if trace > 0 else np.full(values.size, np.nan)
    return values, vectors / np.sqrt(safe), explained


def whiten_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 16,
    scale: float = 64.0,
    shift: int = 1_000_000,
    weights: str = "one",
) -> DataFrame:
    """(id, size, n, deviation, whitened, explained, identity_error) for every usable row.

    An entry c counts as the integer x = floor(scale * c) + shift. Equal x vectors are one
    in the fit, with the number of their rows as weight (``weights="count"``) or with one
    (``"one"``); n is the weight of all and S the weighted sum of each dimension.

    - deviation, decimal(38, 0): the exact sum over dimensions of (n * x - S) squared;
    - whitened, array<double>: x - S / n on the leading unit eigenvectors of the covariance,
      over the roots of their eigenvalues, by falling eigenvalue. Eigenvectors have their
      largest entry positive and are the same for all rows;
    - explained, array<double>: each eigenvalue's share of the trace;
    - identity_error: the largest absolute entry of the whitened vectors' covariance less
      the identity.

    There are ``components`` of them, fewer where vectors are shorter. A component whose
    eigenvalue is no more than rounding (equal, constant or dependent dimensions, a single
    vector) is null in whitened and left out of identity_error; where no component is left
    that is null, as is explained where nothing varies at all. Vectors of each length are
    fitted and whitened by themselves, their length being ``size``.

    Rows whose vector is null or empty, holds null or non-finite entries, or an entry with
    2**53 or more times 1 / scale are left out. Repeated rows and null ids stay rows; an
    empty table gives no rows; other columns are not read. Runs jobs.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    spark = vectors.sparkSession
    ship_package(spark)

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(2**53))

    def entry(c: Column) -> Column:
        return F.floor(c.cast("double") * scale).cast("bigint") + F.lit(shift).cast("bigint")

    rows = (
        vectors.select(named_column(id_col).alias("id"), named_column(vector_col).alias("v"))
        .filter(F.coalesce(F.forall("v", usable) & (F.size("v") > 0), F.lit(False)))
        .select("id", F.transform("v", entry).alias("x"))
    )
    key = F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)
    different = written(
        rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("weight", F.col("rows") if weights == "count" else F.lit(1).cast("bigint")),
        "vectors",
    )
    sums = _exact_sums(different, "weight")

    def centred(size: int, x: np.ndarray) -> np.ndarray:
        n, total = sums[size]
        return (deviations(x, n, total) / n).astype(float)

    products = _centred_products(different, "x", "weight", centred)
    model = {
        size: principal_components(product / sums[size][0], components)
        for size, product in products.items()
    }
    projections = {size: found[1] for size, found in model.items()}

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, weight = batch.column("key"), batch.column("weight")
            for size, at, x in _by_length(batch, "x"):
                n, total = sums[size]
                d = deviations(x, n, total)
                white = (d / n).astype(float) @ projections[size]
                cells = pa.array(white.ravel(), from_pandas=True)
                offsets = np.arange(at.size + 1, dtype=np.int32) * white.shape[1]
                squares = [Decimal(s) for s in squared_lengths(d)]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(at), pa.array([size] * at.size, pa.int32()), weight.take(at),
                     pa.array(squares, pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(offsets, cells)],
                    ["key", "size", "weight", "deviation", "whitened"])

    white = written(
        different.select(key.alias("key"), "x", "weight").mapInArrow(
            whiten,
            "key string, size int, weight bigint, deviation decimal(38,0), whitened array<double>",
        ),
        "whitened",
    )
    errors = _identity_errors(white, {size: sums[size][0] for size in model}, projections)
    facts = spark.createDataFrame(
        [(size, sums[size][0], [None if np.isnan(e) else float(e) for e in found[2]], errors[size])
         for size, found in model.items()],
        "size int, n bigint, explained array<double>, identity_error double",
    )
    return (
        rows.select("id", key.alias("key"))
        .join(white.select("key", "size", "deviation", "whitened"), "key")
        .join(F.broadcast(facts), "size")  # one row for each vector length
        .select("id", "size", "n", "deviation", "whitened", "explained", "identity_error")
    )


def _identity_errors(
    white: DataFrame, totals: dict[int, int], projections: dict[int, np.ndarray]
) -> dict[int, float | None]:
    """{length: largest absolute entry of cov(whitened) - identity, or None}."""
    kept = {size: np.flatnonzero(~np.isnan(p[0])) for size, p in projections.items()}
    width = max((p.shape[1] for p in projections.values()), default=0)
    means = {
        r["size"]: np.array([r[f"m{k}"] or 0.0 for k in range(width)]) / totals[r["size"]]
        for r in white.groupBy("size").agg(
            *[F.sum(F.get("whitened", F.lit(k)) * F.col("weight")).alias(f"m{k}")
              for k in range(width)]
        ).collect()
    } if width else {}

    # The matrix of a row's length is told by how many entries it has, so rows are taken
    # length by length: there are few lengths.
    errors: dict[int, float | None] = {}
    for size, some in kept.items():
        if not some.size:
            errors[size] = None
            continue

        def centred(_: int, w: np.ndarray, size: int = size, some: np.ndarray = some) -> np.ndarray:
            return w[:, some] - means[size][some]

        found = _centred_products(white.filter(F.col("size") == size), "whitened", "weight", centred)
        covariance = next(iter(found.values())) / totals[size]
        errors[size] = float(np.abs(covariance - np.eye(some.size)).max())
    return errors
