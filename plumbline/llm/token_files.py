"""Token ids of documents in compressed files with access to single documents.

A bundle is a folder of three Parquet tables, so that any store Spark writes to can hold
it and a failed task leaves nothing behind:

- ``dictionary``: one row; a zstandard dictionary trained on serialized id arrays, its
  SHA-256 and the width of an id in bytes;
- ``blocks``: runs of documents in ascending id order. Every document is a zstandard
  frame of its own, made with the dictionary; ``offsets`` (little-endian uint32) has where
  each frame begins, ``counts`` how many ids it holds, and ``dictionary`` the hash of the
  dictionary to read it with;
- ``parts``: for each part, how many ids come before it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from plumbline.llm.common import by_size, id_and_text, ship_package
from plumbline.llm.pieces import byte_pieces, gather

#: Pieces a Python worker keeps in its newer table, and as many in the older one. When the
#: newer is full it becomes the older, so pieces in use stay known; no result depends on it.
KEPT_PIECES = 500_000
#: Pieces that reach the library at once; what it returns for each is much larger than its ids.
_PIECES_AT_ONCE = 8192
_BLOCK = "part int, block int, dictionary string, start bigint, n_ids bigint, ids array<{id}>, offsets binary, counts binary, frames binary"


class PieceTokenizer:
    """A byte-level tokenizer of the tokenizers library that meets each piece once.

    The library cuts a text into pieces by a pattern and encodes them one by one. Here
    the pieces of many texts are cut together and only different ones reach the library.
    """

    def __init__(self, path: str, special_as_text: bool = False, most_kept: int | None = None):
        self.most_kept = KEPT_PIECES if most_kept is None else most_kept
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # As text, the string of a special token is cut into pieces like any other.
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        # The same tokenizer for what the pattern has already cut.
        self.by_piece = Tokenizer.from_str(self.library.to_str())
        self.by_piece.pre_tokenizer = pre_tokenizers.ByteLevel(
            add_prefix_space=False, use_regex=False
        )
        self.by_piece.encode_special_tokens = special_as_text
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _bytes(self, library: Tokenizer, texts: list[str]) -> list[bytes]:
        # The fast form leaves out offsets into the text, which nothing here uses.
        return [
            array("I", x.ids).tobytes()
            for start in range(0, len(texts), _PIECES_AT_ONCE)
            for x in library.encode_batch_fast(
                texts[start : start + _PIECES_AT_ONCE], add_special_tokens=False
            )
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as the library gives them without added special tokens."""
        whole = [any(s in text for s in self.special) for text in texts]
        pieces, counts = byte_pieces(["" if w else text for w, text in zip(whole, texts)])
        coded = pieces.dictionary_encode()
        if len(self.kept) > self.most_kept:
            self.older, self.kept = self.kept, {}
        kept, different = self.kept, coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(kept.get, different))
        lacking = [n for n, ids in enumerate(found) if ids is None]
        again = list(map(self.older.get, map(different.__getitem__, lacking)))
        unknown = [n for n, ids in zip(lacking, again) if ids is None]
        made = iter(self._bytes(self.by_piece, [different[n] for n in unknown]))
        for n, ids in zip(lacking, again):
            kept[different[n]] = found[n] = next(made) if ids is None else ids
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int64)
        codes = coded.indices.to_numpy()
        ids = gather(np.frombuffer(b"".join(found), "<u4"), offsets, codes)
        before = np.concatenate([[0], np.cumsum(np.diff(offsets)[codes])])
        ends = before[np.cumsum(counts)].tolist()
        split = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for row in np.flatnonzero(whole).tolist():
            split[row] = np.frombuffer(self._bytes(self.library, [texts[row]])[0], "<u4")
        return split


@cache
def _tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def _serialized(ids: np.ndarray, end: int, width: int) -> bytes:
    return np.append(ids, np.uint32(end)).astype(f"<u{width}").tobytes()


def _train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary for arrays like the samples; with too few, their own bytes serve as one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    magic = data[:4] == (0xEC30A437).to_bytes(4, "little")
    kind = zstandard.DICT_TYPE_FULLDICT if magic else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def write_bundle(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    dictionary_documents: int = 1000,
    dictionary_bytes: int = 112_640,
    sample_bytes: int = 1 << 16,
    block_bytes: int = 1 << 20,
    level: int = 3,
) -> None:
    """Encode every text whole, append ``end_id``, and write the bundle to ``path``.

    Documents are in ascending id order, null ids first, equal ids by a hash of their text,
    then by the text, so that one id's many rows are dealt out to tasks; null texts count as
    empty and hold the end id alone. The dictionary is trained on at most
    ``dictionary_documents`` documents, those with the least hash of the id, and at most
    ``sample_bytes`` from each; it changes sizes, never contents. An empty table gives a
    bundle without documents. Columns besides id and text are not read.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    chosen = source.select("id").filter("id is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(dictionary_documents)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(tokenizer)
        for part in by_size(batches):
            rows = [
                _serialized(ids, end_id, model.width)[:sample_bytes]
                for ids in model.encode(part.column("text").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["x"])

    texts = source.join(F.broadcast(chosen), "id").select("text")
    samples = sorted(bytes(r["x"]) for r in texts.mapInArrow(sample, "x binary").collect())
    trained = _train_dictionary(samples, dictionary_bytes)
    digest = hashlib.sha256(trained).hexdigest()
    width = _tokenizer(tokenizer).width
    spark.createDataFrame(
        [(digest, trained, width)], "dictionary string, data binary, width int"
    ).coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(tokenizer)
        shared = _dictionary(trained)
        shared.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        number, before = 0, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number, before, held
            ids, counts, frames = zip(*held)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype("<u4")
            total = sum(counts)
            row = {
                "part": [TaskContext.get().partitionId()], "block": [number],
                "dictionary": [digest], "start": [before], "n_ids": [total],
                "ids": [[*ids]], "offsets": [offsets.tobytes()],
                "counts": [np.array(counts, "<u4").tobytes()], "frames": [b"".join(frames)],
            }
            number, before, held = number + 1, before + total, []
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()),
             ("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(id_type)),
             ("offsets", pa.binary()), ("counts", pa.binary()), ("frames", pa.binary())]
        )
        size = 0
        for part in by_size(batches):
            numbers = part.column("id").to_pylist()
            for number_, ids in zip(numbers, model.encode(part.column("text").to_pylist())):
                frame = packer.compress(_serialized(ids, end_id, model.width))
                held.append((number_, len(ids) + 1, frame))
                size += len(frame) + 16
                if size >= block_bytes:
                    yield block()
                    size = 0
        if held:
            yield block()

    id_type = _arrow_type(kind)
    place = ["id", F.xxhash64("text")]
    ordered = source.repartitionByRange(*place).sortWithinPartitions(*place, "text")
    ordered.mapInArrow(blocks, _BLOCK.format(id=kind)).write.option(
        "compression", "uncompressed"
    ).parquet(f"{path}/blocks")

    sizes = (
        spark.read.parquet(f"{path}/blocks").groupBy("part")
        .agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    )  # one row for each task of the write
    starts, before = [], 0
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(starts, "part int, part_start bigint").coalesce(1).write.parquet(
        f"{path}/parts"
    )


def _arrow_type(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in known:
        raise ValueError(f"ids of type {kind} can't be written; use bigint, int or string")
    return known[kind]


def read_bundle(spark: SparkSession, path: str, only: list | None = None) -> DataFrame:
    """(id, start, ids binary) of the documents in a bundle, or of those with given ids.

    ``start`` is the number of ids before the document, ``ids`` are little-endian unsigned
    32-bit integers with the end id last. With ``only``, blocks without such a document
    are not opened and of the others just the wanted frames are decompressed.
    """
    ship_package(spark)
    found = spark.read.parquet(f"{path}/dictionary").collect()
    dictionaries = {r["dictionary"]: (bytes(r["data"]), r["width"]) for r in found}
    for digest, (data, _) in dictionaries.items():
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError("the dictionary does not match its hash")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType
    wanted = None if only is None else set(only)
    if wanted is not None:
        blocks = blocks.filter(
            F.arrays_overlap("ids", F.array(*[F.lit(x).cast(kind) for x in wanted]))
        )
    parts = spark.read.parquet(f"{path}/parts")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {}
        for digest, (data, width) in dictionaries.items():
            readers[digest] = (zstandard.ZstdDecompressor(dict_data=_dictionary(data)), width)
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row] for name in batch.schema.names}
                unpack, width = readers[r["dictionary"].as_py()]
                offsets = np.frombuffer(r["offsets"].as_buffer(), "<u4")
                counts = np.frombuffer(r["counts"].as_buffer(), "<u4").astype(np.int64)
                starts = r["part_start"].as_py() + r["start"].as_py() + np.cumsum(counts) - counts
                frames, ids = memoryview(r["frames"].as_buffer()), r["ids"].as_py()
                out = [[], [], []]
                for n, number in enumerate(ids):
                    if wanted is not None and number not in wanted:
                        continue
                    raw = unpack.decompress(frames[offsets[n] : offsets[n + 1]])
                    out[0].append(number)
                    out[1].append(int(starts[n]))
                    out[2].append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], batch.schema.field("ids").type.value_type),
                     pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                    ["id", "start", "ids"],
                )

    joined = blocks.join(F.broadcast(parts), "part")
    return joined.mapInArrow(documents, f"id {kind.simpleString()}, start bigint, ids binary")
