"""SimHash fingerprints of documents, and the search for near ones.

Every term of a text (runs of a few words) is hashed; its weight votes for or against
each bit of the fingerprint by the sign its hash has there. Texts that share terms get
fingerprints that differ in few bits. The search cuts fingerprints into blocks and makes
one table per choice of blocks that stay equal: fingerprints within the radius agree on
all blocks of at least one table, so equal keys find them all and a bit count verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import by_size, id_and_text, written

BITS = 128
_TERMS_AT_ONCE = 1 << 14
# Odd multipliers of a published 64-bit finalizer (splitmix64) and its increment.
_MIX_1, _MIX_2, _STEP = (
    np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15),
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _term_hashes(text: str, words_per_term: int) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = max(len(words) - words_per_term + 1, 1)
    term = np.zeros(count, np.uint64)
    for n in range(min(words_per_term, len(words))):
        term = _mixed(term * _MIX_2 + _STEP + hashed[n : n + count])
    return term


def text_fingerprints(texts: list[str], words_per_term: int = 3) -> np.ndarray:
    """(texts, BITS / 8) uint8. Terms weigh 1 + floor(log2(occurrences)); no term, no bit."""
    hashes, weights, sizes = [], [], []
    for text in texts:
        term, times = np.unique(_term_hashes(text, words_per_term), return_counts=True)
        hashes.append(term)
        weights.append(np.frexp(times)[1])
        sizes.append(term.size)
    votes = np.zeros((len(texts), BITS), np.int64)
    if not texts:
        return np.packbits(votes > 0, axis=1)
    term, weight = np.concatenate(hashes), np.concatenate(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for a in range(0, term.size, _TERMS_AT_ONCE):
        part = term[a : a + _TERMS_AT_ONCE]
        halves = np.column_stack([part, _mixed(part + _STEP)]).astype(">u8")
        signs = np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int16) * np.int16(2)
        signs -= np.int16(1)
        signs *= weight[a : a + _TERMS_AT_ONCE, None].astype(np.int16)
        rows = owner[a : a + _TERMS_AT_ONCE]
        first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
        votes[rows[first]] += np.add.reduceat(signs, first, axis=0, dtype=np.int64)
    return np.packbits(votes > 0, axis=1)


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal bits of fingerprints, row by row."""
    return 1 - np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) / BITS


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_term: int = 3
) -> DataFrame:
    """(id, fingerprint) for every row: 32 lowercase hexadecimal digits.

    Words are runs of characters other than ASCII white space, lower-cased; a text with
    fewer words than a term is one term. Null and empty texts have fingerprint 0. Equal
    texts have equal fingerprints, repeated rows stay rows, an empty table gives none,
    and columns besides id and text are not read.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches):
            found = text_fingerprints(part.column("text").to_pylist(), words_per_term)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([f.tobytes().hex() for f in found], pa.string())],
                ["id", "fingerprint"],
            )

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(make, f"id {kind}, fingerprint string")


def near_fingerprints(
    queries: DataFrame, all_rows: DataFrame, radius: int = 3, blocks: int | None = None
) -> DataFrame:
    """(query_fingerprint, fingerprint, distance, n_rows): all within ``radius`` bits.

    Both frames are (id, fingerprint) as :func:`fingerprints` makes them. Equal
    fingerprints are one row with the number of rows that have it, so a large group of
    copies meets in no join. Tables fix ``blocks - radius`` of the blocks; with two blocks
    more than the radius (the default) a key has a good part of the bits. A pair that meets
    in several tables is given by the first of them. Null fingerprints find nothing.
    """
    blocks = radius + 2 if blocks is None else blocks
    digits = BITS // 4
    if not 0 <= radius < blocks <= digits:
        raise ValueError("blocks must be more than the radius and at most one per digit")
    cuts = [digits * n // blocks for n in range(blocks + 1)]

    def keyed(df: DataFrame) -> DataFrame:
        block = [
            F.substring("fingerprint", a + 1, b - a) for a, b in zip(cuts, cuts[1:])
        ]
        tables = [
            F.struct(F.lit(n).alias("table"), F.concat(*[block[b] for b in kept]).alias("key"))
            for n, kept in enumerate(combinations(range(blocks), blocks - radius))
        ]
        return df.select("*", F.explode(F.array(*tables)).alias("t")).select(
            *df.columns, "t.table", "t.key"
        )

    rows = all_rows.filter("fingerprint is not null").groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    asked = queries.select(F.col("fingerprint")).filter("fingerprint is not null").distinct()
    left = keyed(asked).withColumnRenamed("fingerprint", "query_fingerprint")
    apart = [
        F.bit_count(
            F.conv(F.substring("query_fingerprint", at, 8), 16, 10).cast("bigint").bitwiseXOR(
                F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("bigint")
            )
        )
        for at in range(1, digits, 8)
    ]
    # The first table fixes the first equal blocks, so all others before its last one differ.
    differs = [
        F.substring("query_fingerprint", a + 1, b - a) != F.substring("fingerprint", a + 1, b - a)
        for a, b in zip(cuts, cuts[1:])
    ]
    first = F.lit(False)
    for n, kept in enumerate(combinations(range(blocks), blocks - radius)):
        own = F.col("table") == n
        for block in set(range(kept[-1])) - set(kept):
            own = own & differs[block]
        first = first | own
    found = left.join(keyed(rows), ["table", "key"]).withColumn("distance", sum(apart, F.lit(0)))
    return found.filter((F.col("distance") <= radius) & first).select(
        "query_fingerprint", "fingerprint", "distance", "n_rows"
    )


def with_near_counts(rows: DataFrame, is_query: Column, radius: int = 3) -> DataFrame:
    """The rows with ``n_near``: for those that ask, how many other rows' fingerprints are
    within ``radius`` bits of their own, null for the others."""
    found = near_fingerprints(rows.filter(is_query), rows, radius).groupBy("query_fingerprint").agg(
        F.sum("n_rows").alias("n_near")
    )
    near = F.when(is_query, F.col("n_near") - 1)  # but the row itself
    joined = rows.join(found, F.col("fingerprint") == F.col("query_fingerprint"), "left")
    return joined.select(*rows.columns, near.alias("n_near"))


_EDITED = (
    "id {id}, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _edited_rows(ids: pa.Array, texts: list[str], following: list[str], own: np.ndarray,
                 next_own: np.ndarray, words_per_term: int) -> list[pa.Array]:
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, following)]
    changed = text_fingerprints(edited, words_per_term)
    return [
        ids,
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                 pa.string()),
        pa.array([f.tobytes().hex() for f in own], pa.string()),
        pa.array([f.tobytes().hex() for f in changed], pa.string()),
        pa.array(likeness(own, changed), pa.float64()),
        pa.array(likeness(own, next_own), pa.float64()),
    ]


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edit_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_term: int = 3
) -> DataFrame:
    """How alike a document's fingerprint is to its edited text's and to the next document's.

    The next document is the one before it in id order (of equal ids, by a hash of the text,
    then the text, so that one id's many rows are dealt out to tasks; null ids come last);
    after the last comes the first. The edited text has the second half of
    the code points, rounded down, replaced by as many from the start of the next text.

    Texts are shuffled once, into ranges of ids; a task reads its range in order. Only a
    range's last document waits for the first text of the next range: those texts, one
    per task, are written aside and joined afterwards. Null texts count as empty, an empty
    table gives no rows, columns besides id and text are not read. Runs jobs when called.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else None
    if id_type is None:
        raise ValueError("ids must be bigint")
    edited_schema = _EDITED.format(id="bigint")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None

        def aside(role: str, number, text: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, a.type) for a in _edited_rows(
                pa.nulls(0, id_type), [], [], np.zeros((0, BITS // 8), np.uint8),
                np.zeros((0, BITS // 8), np.uint8), words_per_term)]
            empty[0] = pa.array([number], id_type)
            return pa.RecordBatch.from_arrays(
                [*empty, pa.array([part], pa.int32()), pa.array([role]), pa.array([text])],
                [*_NAMES, "part", "role", "text"],
            )

        for piece in by_size(batches):
            ids, texts = piece.column("id").to_pylist(), piece.column("text").to_pylist()
            own = text_fingerprints(texts, words_per_term)
            if held is None:
                yield aside("head", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
                own = np.vstack([held[2], own])
            held = (ids[-1], texts[-1], own[-1:])
            n = len(ids) - 1
            if n:
                rows = _edited_rows(
                    pa.array(ids[:-1], id_type), texts[:-1], texts[1:], own[:-1], own[1:],
                    words_per_term,
                )
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array([part] * n, pa.int32()), pa.array(["row"] * n),
                     pa.nulls(n, pa.string())],
                    [*_NAMES, "part", "role", "text"],
                )
        if held is not None:
            yield aside("tail", held[0], held[1])

    place = [F.desc("id"), F.xxhash64("text").desc()]
    ordered = source.repartitionByRange(*place).sortWithinPartitions(*place, F.desc("text"))
    done = written(
        ordered.mapInArrow(ranges, f"{edited_schema}, part int, role string, text string"), "edited"
    )
    parts = sorted(r["part"] for r in done.filter("role = 'head'").select("part").collect())
    following = spark.createDataFrame(
        list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int"
    )  # one row for each task of the job above
    heads = done.filter("role = 'head'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text")
    )
    ends = (
        done.filter("role = 'tail'").select("id", "text", "part")
        .join(F.broadcast(following), "part").join(heads, "next_part").select("id", "text", "next_text")
    )

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in by_size(batches):
            texts, after = piece.column("text").to_pylist(), piece.column("next_text").to_pylist()
            own, next_own = (text_fingerprints(t, words_per_term) for t in (texts, after))
            yield pa.RecordBatch.from_arrays(
                _edited_rows(piece.column("id"), texts, after, own, next_own, words_per_term), _NAMES
            )

    rows = done.filter("role = 'row'").select(*_NAMES)
    return rows.unionByName(ends.mapInArrow(last, edited_schema))
