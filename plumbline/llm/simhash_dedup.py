"""SimHash near-duplicates of documents, compared exactly tile by tile.

Documents are reduced to 64-bit fingerprints, equal fingerprints to one. Fingerprints
are then grouped into tiles by their number of set bits: two fingerprints that differ in
at most r bits have counts at most r apart, so other tile pairs are skipped. The pairs
of tiles that remain are compared whole, with exclusive-or and bit counts in numpy.

Every pair of tiles is a group of its own, a tile holds at most about ``tile_rows``
fingerprints, and a group returns a spanning forest of its links, not the links: a group
of copies of any size costs rows in proportion to its size. The number of comparisons
grows with the square of the number of different fingerprints; that is the method.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import by_size, connected_components, free_names, id_and_text, written

SEED = 42
_SHINGLES_AT_ONCE = 1 << 16


def _fingerprint(text: str, shingle: int) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(end + 1 for end in ends[:-1])]
    spans = list(zip(starts, ends[shingle - 1 :])) or [(0, len(joined))]
    hashed, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), _SHINGLES_AT_ONCE):
        part = spans[at : at + _SHINGLES_AT_ONCE]
        values = np.fromiter((hashed(joined[s:e], SEED) for s, e in part), "<u8", len(part))
        bits = np.unpackbits(values.view(np.uint8), bitorder="little")
        set_bits += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    over_half = (2 * set_bits > len(spans)).astype(np.uint8)
    return int(np.packbits(over_half, bitorder="little").view("<i8")[0])


def simhash_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4
) -> DataFrame:
    """(id, fingerprint bigint) for every row; the 64 bits are those of the bigint.

    A-Z are lower-cased, words are runs of characters other than ASCII white space, and
    shingles are ``shingle`` words joined by a space, each time they occur. A text with
    fewer words is one shingle. A null text counts as empty, and a text without words has
    fingerprint 0. A bit is set if it is set in more than half of the shingles' XXH64.
    """
    if shingle < 1:
        raise ValueError("shingle must be at least 1")

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches):
            found = [_fingerprint(text, shingle) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(found, pa.int64())], ["id", "fingerprint"]
            )

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(fingerprints, f"id {kind}, fingerprint bigint")


def fingerprint_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of the components after linking left[i] to right[i]; a label is the least row."""
    while left.size:
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
    return labels


def _low_counts(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values & np.uint64(0xFFFFFFFF)).astype(np.int64)


def linked_in_tiles(
    left: np.ndarray, right: np.ndarray | None, radius: int, at_once: int = 1 << 20
) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components among two tiles of fingerprints (uint64).

    ``right`` is None for a tile with itself. Rows of both are taken in the order of the
    set bits in their lower half, and ranges whose counts in the two halves differ by
    more than the radius are skipped, like tiles whose counts do.
    """
    values = left if right is None else np.concatenate([left, right])
    offset = 0 if right is None else left.size
    other = values[offset:]
    low, low_other = _low_counts(left), _low_counts(other)
    high = np.bitwise_count(left).astype(np.int64) - low
    high_other = np.bitwise_count(other).astype(np.int64) - low_other
    labels = np.arange(values.size)
    by_low = {n: np.flatnonzero(low == n) for n in np.unique(low)}
    by_low_other = {n: np.flatnonzero(low_other == n) for n in np.unique(low_other)}
    for n, rows in by_low.items():
        for m, columns in by_low_other.items():
            gap = max(
                0,
                high[rows].min() - high_other[columns].max(),
                high_other[columns].min() - high[rows].max(),
            )
            if abs(n - m) + gap > radius or (right is None and m < n):
                continue
            there = other[columns]
            step = max(1, at_once // there.size)
            for start in range(0, rows.size, step):
                some = rows[start : start + step]
                differing = np.bitwise_count(left[some][:, None] ^ there)
                i, j = np.nonzero(differing <= radius)
                if i.size:
                    labels = _merge(labels, some[i], columns[j] + offset)
    linked = np.flatnonzero(labels != np.arange(values.size))
    return values[linked], values[labels[linked]]


def _tile_links(distinct: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(a, b) fingerprints that span the components of all links between different ones."""
    counted = distinct.select("fingerprint", F.bit_count("fingerprint").alias("bits"))
    per_count = {r["bits"]: r["n"] for r in counted.groupBy("bits").agg(
        F.count(F.lit(1)).alias("n")
    ).collect()}  # at most 65 rows
    tiles = F.array(*[F.lit(-(-per_count.get(n, 0) // tile_rows)) for n in range(65)])
    placed = counted.withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.get(tiles, "bits")))
    paired = (
        placed.withColumn(
            "bits_2",
            F.explode(
                F.sequence(
                    F.greatest(F.col("bits") - radius, F.lit(0)),
                    F.least(F.col("bits") + radius, F.lit(64)),
                )
            ),
        )
        .withColumn("n_tiles", F.get(tiles, "bits_2"))
        .filter("n_tiles > 0")
        .withColumn("tile_2", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    )
    own = F.struct(F.col("bits").cast("int").alias("bits"), F.col("tile").cast("int").alias("tile"))
    far = F.struct(
        F.col("bits_2").cast("int").alias("bits"), F.col("tile_2").cast("int").alias("tile")
    )
    keyed = paired.select(
        F.least(own, far).alias("first"),
        F.greatest(own, far).alias("second"),
        (own > far).alias("is_second"),
        "fingerprint",
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
        second = rows["is_second"].to_numpy(bool)
        same = rows["first"].iloc[0] == rows["second"].iloc[0]
        left, right = values[~second], values[second]
        if same:
            a, b = linked_in_tiles(left, None, radius)
        elif left.size and right.size:
            a, b = linked_in_tiles(left, right, radius)
        else:
            a = b = values[:0]
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return keyed.groupBy("first", "second").applyInPandas(compare, "a bigint, b bigint")


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    tile_rows: int = 1 << 15,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``max_bits`` bits;
    component_id is the least id reachable over links. Rows with equal ids or texts stay
    rows. Null ids take part; they are nobody's component_id unless a whole component has
    none. Empty and null texts have fingerprint 0, linked like any other. Ties cannot
    matter: the result depends only on the set of fingerprints. An empty table gives
    none. Other columns, whatever their names, are not read. Runs jobs when called.
    """
    fingerprints = written(
        simhash_fingerprints(docs, id_col, text_col, shingle), "fingerprints"
    )
    distinct = written(
        fingerprints.groupBy("fingerprint").agg(F.min("id").alias("least_id")), "distinct"
    )
    links = written(_tile_links(distinct, max_bits, tile_rows), "links")
    roots = connected_components(links)
    linked = distinct.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint"
    ).select("fingerprint", "component", "least_id")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, "component").select("fingerprint", "component_id")
    component = distinct.join(named, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least_id").alias("component_id")
    )
    return fingerprints.join(component, "fingerprint").select("id", "fingerprint", "component_id")


def one_per_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
) -> DataFrame:
    """The rows of ``docs`` with the least id of each component, all columns as they are.

    Rows go only within one component: where an id has several texts, those that are no
    near-duplicates of each other are each judged with their own component. Of near ones
    with the least id, the one with the least hash of its text stays, once if repeated.
    Rows without an id are told apart by their text and stay only if their whole component
    has none.
    """
    number = F.col(id_col).cast("bigint")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    without = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_col), 2)
    key = F.struct(F.coalesce(number, without).alias("id"), hashed.alias("text"))
    (name,) = free_names(docs, "key")
    keyed = docs.withColumn(name, key)
    # Equal texts have one component, so id and text tell which row is its least.
    found = simhash_components(keyed, name, text_col, shingle, max_bits)
    kept = found.filter("id = component_id").select(F.col("id").alias(name)).distinct()
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
