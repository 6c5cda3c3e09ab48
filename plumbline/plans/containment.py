"""Which texts contain which items, without comparing every pair.

A text that contains an item also contains every window of 1, 2, 4 or 8 bytes inside the
item's UTF-8. A window is one integer, so each item is keyed by one window of the largest
size that fits in it, the one that the texts have least often. The texts' windows are
looked up in a Bloom filter over all keys while a text is read, so only windows that may
be a key ever become rows. Equal windows give the candidates, and each candidate is
checked with an exact ``contains``.

Windows are worked out with numpy on many texts at once (Arrow batches): Spark's own
functions would make an object of every character several times over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.shipping import ship_package

SIZES = (1, 2, 4, 8)
#: Cells of the sketch that counts windows, for each size: all windows of two bytes.
SKETCH_BITS = 16
#: Bounds of the Bloom filter. With more keys than a 32nd of the most bits it lets more
#: windows through, which costs rows and changes nothing else.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Keys of up to so many bytes of item text are broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 8 << 20
#: Few enough bytes that the arrays made of them stay in a processor's cache.
_SLICE_BYTES = 1 << 18
#: Odd factors of multiplicative hashing, two for each size.
_FACTORS = {
    size: tuple(np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) % (1 << 64)) for n in (size, 16 + size))
    for size in SIZES
}


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with a bounded number of bytes."""
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(large):
        last = np.searchsorted(offsets, offsets[row] + _SLICE_BYTES, "right") - 1
        last = min(max(int(last), row + 1), len(large))
        yield row, every[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def _windows(data: np.ndarray, largest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, the window that begins at each byte) for every size up to the largest."""
    value = data.astype(np.uint64)
    for size in SIZES:
        if size > largest or value.size == 0:
            return
        yield size, value
        # The next size joins two windows of this one, the later above the earlier.
        value = value[:-size] | (value[size:] << np.uint64(8 * size))


def _spots(size: int, values: np.ndarray, bits: int, which: int = 0) -> np.ndarray:
    """A hash of windows below 2**bits."""
    return ((values * _FACTORS[size][which]) >> np.uint64(64 - bits)).view(np.int64)


def _cells(size: int, values: np.ndarray) -> np.ndarray:
    """The windows' cells in the sketch of their size; windows of one or two bytes have
    cells of their own."""
    return values.view(np.int64) if size <= 2 else _spots(size, values, SKETCH_BITS)


def _window_counts(texts: DataFrame, used: list[int]) -> np.ndarray:
    """A count-min sketch of the windows of each used size in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SIZES), 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            for _, data, offsets in _slices(batch.column("text")):
                for size, values in _windows(data, used[-1]):
                    if size in used:
                        # Windows across two texts are counted too: this is an estimate.
                        cells = _cells(size, values)
                        total[SIZES.index(size)] += np.bincount(cells, minlength=1 << SKETCH_BITS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total.ravel()[seen])], ["cell", "n"]
        )

    counted = (
        texts.select("text").mapInArrow(count, "cell bigint, n bigint")
        .groupBy("cell").agg(F.sum("n").alias("n"))
    )
    total = np.zeros((len(SIZES), 1 << SKETCH_BITS), np.int64)
    found = counted.toArrow()  # at most one row for each cell of the sketch
    total.ravel()[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return total


def _keyed(items: DataFrame, counts: np.ndarray | None) -> DataFrame:
    """(item_id, item_text, size, run): the key of every item, as a signed integer."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs = [], []
            for text in batch.column("item_text").cast(pa.binary()).to_pylist():
                data = np.frombuffer(text, np.uint8)
                *_, (size, values) = _windows(data, data.size)
                at = 0
                if counts is not None:
                    at = int(counts[SIZES.index(size)][_cells(size, values)].argmin())
                sizes.append(size)
                runs.append(values[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), batch.column("item_text"), pa.array(sizes, pa.int32()),
                 pa.array(np.array(runs, np.uint64).view(np.int64))],
                ["item_id", "item_text", "size", "run"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(choose, f"item_id {kind}, item_text string, size int, run bigint")


def _bloom_filter(keys: DataFrame, count: int) -> np.ndarray:
    """Two bits for every different key, in a table of bytes on the driver, of bounded size."""
    bits = min(max((32 * count - 1).bit_length(), LEAST_BITS.bit_length() - 1),
               MOST_BITS.bit_length() - 1)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            runs = batch.column("run").to_numpy().view(np.uint64)
            place = np.concatenate([
                _spots(size, runs[sizes == size], bits, which) for size in SIZES for which in (0, 1)
            ])
            yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])

    place = F.col("place")
    words = (
        keys.select("size", "run").mapInArrow(spots, "place bigint")
        .groupBy(F.shiftright(place, 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
    )
    table = np.zeros(1 << (bits - 6), np.int64)
    found = words.toArrow()  # at most one row for each word of the table
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def text_windows(texts: DataFrame, used: list[int], bloom: np.ndarray) -> DataFrame:
    """(text_id, text, hits) of texts with windows in the filter; each window once."""
    bits = bloom.size.bit_length() + 5

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bloom.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows, sizes, runs = [], [], []
            for first, data, offsets in _slices(batch.column("text")):
                for size, values in _windows(data, used[-1]):
                    if size not in used:
                        continue
                    at = np.flatnonzero(known[_spots(size, values, bits)])
                    at = at[known[_spots(size, values[at], bits, 1)]]
                    row = np.searchsorted(offsets, at, "right") - 1
                    whole = at + size <= offsets[row + 1]
                    row, value = row[whole], values[at[whole]]
                    order = np.lexsort((value, row))
                    row, value = row[order], value[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: row.size]
                    rows.append(row[new] + first)
                    runs.append(value[new].view(np.int64))
                    sizes.append(np.full(rows[-1].size, size, np.int32))
            if not rows:
                continue
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            some, begins = np.unique(row[order], return_index=True)
            hits = pa.ListArray.from_arrays(
                np.append(begins, row.size).astype(np.int32),
                pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(sizes)[order]), pa.array(np.concatenate(runs)[order])],
                    ["size", "run"],
                ),
            )
            took = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays(
                [took.column("text_id"), took.column("text"), hits], ["text_id", "text", "hits"]
            )

    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.mapInArrow(
        find, f"text_id {kind}, text string, hits array<struct<size: int, run: bigint>>"
    )


def containment_pairs(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (text_id, item_id) of texts that contain items, ignoring case.

    ``texts`` has ``text_id, text``; ``items`` has ``item_id`` and ``item_text``. Ids may
    repeat or be null: a pair is given if any text of that id contains any item of that
    id. Null and empty items are in no text.

    Jobs run when this is called: one row about the items, a sketch of the texts' windows
    and a Bloom filter reach the driver, the last two of a fixed greatest size. The texts
    are then read once. Items of up to ``BROADCAST_BYTES`` are broadcast and checked on
    the spot; more are matched by a shuffle of windows without their texts, which are
    fetched for the candidates alone.
    """
    spark = texts.sparkSession
    ship_package(spark)
    texts = texts.select("text_id", F.lower("text").alias("text")).filter(F.length("text") > 0)
    items = items.select("item_id", F.lower("item_text").alias("item_text"))
    items = items.filter(F.length("item_text") > 0).distinct()
    length = F.octet_length("item_text")
    largest = F.lit(SIZES[0])
    for size in SIZES[1:]:
        largest = F.when(length >= size, size).otherwise(largest)
    facts = items.agg(
        F.collect_set(largest).alias("sizes"), F.count(F.lit(1)).alias("n"),
        F.sum(length).alias("bytes"), F.max(length).alias("longest"),
    ).first()
    used = sorted(facts["sizes"])
    if not used:
        nothing = texts.select("text_id").filter(F.lit(False))
        return nothing.withColumn("item_id", F.lit(None).cast(items.schema["item_id"].dataType))

    # An item that is no longer than its window leaves nothing to choose.
    choice = facts["longest"] not in SIZES or len(used) > 1
    keys = _keyed(items, _window_counts(texts, used) if choice else None)
    found = text_windows(texts, used, _bloom_filter(keys, facts["n"]))
    hits = found.select("text_id", "text", F.explode("hits").alias("hit")).select(
        "text_id", "text", F.col("hit.size").alias("size"), F.col("hit.run").alias("run")
    )
    if facts["bytes"] <= BROADCAST_BYTES:
        checked = hits.join(F.broadcast(keys), ["size", "run"])
    else:
        # Spark takes a text's windows for as many rows as the texts, so neither they nor
        # the texts may be broadcast.
        pairs = hits.drop("text").hint("shuffle_merge").join(keys, ["size", "run"])
        candidates = pairs.select("text_id", "item_id", "item_text").distinct()
        named = texts.withColumnRenamed("text_id", "_id").hint("shuffle_merge")
        checked = named.join(candidates, F.col("text_id").eqNullSafe(F.col("_id")))
    return (
        checked.filter(F.col("text").contains(F.col("item_text")))
        .select("text_id", "item_id")
        .distinct()
    )
