"""Byte-pair encoding and decoding, with a segment tree over the ranks of adjacent pairs.

The tokenizer file (public format of the tokenizers library) gives merges, vocabulary
and special tokens; a task loads it once from a path that every executor can read. Texts
are normalized and cut into pieces for a slice at a time, each different piece of a slice
is encoded once, and a bounded table keeps the pieces a worker has met.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm.common import by_size, id_and_text, ship_package
from plumbline.llm.pieces import gather, word_pieces

NO_PAIR = 1 << 62
_POSITION_BITS = 32
#: Pieces a Python worker keeps; beyond it the table is emptied, which changes no result.
KEPT_PIECES = 200_000


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    shown = dict(zip(printable, map(chr, printable))) | {
        byte: chr(256 + n) for n, byte in enumerate(rest)
    }
    return [shown[byte] for byte in range(256)]


def merge_pieces(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges, always the pair of lowest rank, the leftmost of equals.

    ``merges`` has (rank, merged symbol) by pair. Leaf i of the tree has the rank of the
    pair that starts at symbol i together with i, so the least leaf, at the root, is the
    leftmost pair of lowest rank. A merge changes three leaves; each update climbs to the
    root, which is logarithmic in the number of symbols.
    """
    count = len(symbols)
    if count < 2:
        return symbols
    width = 1 << (count - 2).bit_length() if count > 2 else 1
    tree = [NO_PAIR] * (2 * width)
    known = merges.get
    for i in range(count - 1):
        found = known((symbols[i], symbols[i + 1]))
        if found:
            tree[width + i] = found[0] << _POSITION_BITS | i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    symbols = list(symbols)
    following = list(range(1, count + 1))
    preceding = list(range(-1, count - 1))

    def put(leaf: int, value: int) -> None:
        node = width + leaf
        if tree[node] == value:
            return
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def rank_at(left: int, right: int) -> int:
        found = known((symbols[left], symbols[right]))
        return found[0] << _POSITION_BITS | left if found else NO_PAIR

    while tree[1] != NO_PAIR:
        left = tree[1] & ((1 << _POSITION_BITS) - 1)
        right = following[left]
        symbols[left] = known((symbols[left], symbols[right]))[1]
        after = following[right]
        following[left] = after
        if right < count - 1:
            put(right, NO_PAIR)
        if after < count:
            preceding[after] = left
            put(left, rank_at(left, after))
        else:
            put(left, NO_PAIR)
        before = preceding[left]
        if before >= 0:
            put(before, rank_at(before, left))
    kept, at = [], 0
    while at < count:
        kept.append(symbols[at])
        at = following[at]
    return kept


class WordBPE:
    """A byte-level BPE with word ends, as in a tokenizer file of that kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        ending = spec["model"]["end_of_word_suffix"] or ""
        self.merges = {
            (vocab[a], vocab[b]): (rank, vocab[a + b])
            for rank, (a, b) in enumerate(spec["model"]["merges"])
        }
        alphabet = _byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + ending] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile(
            "(" + "|".join(re.escape(s) for s in self.special) + ")"
        )
        names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, number in (vocab | self.special).items():
            names[number] = token
        self.names = pa.array(names)
        self.kept: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if piece in self.special:
            ids = [self.special[piece]]
        else:
            raw = piece.encode()
            ids = merge_pieces([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.merges)
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and how many each text has."""
        parts, owner, marks = [], [], []
        for number, text in enumerate(texts):
            # Special tokens are looked for in the raw text, before it is normalized.
            for part in self.split_special.split(text) if "<|" in text else (text,):
                if part in self.special:
                    marks.append((len(parts), part))
                    part = ""
                parts.append(_normalized(part))
                owner.append(number)
        pieces, counts = word_pieces(parts)
        if marks:  # an own piece in place of each empty part that stands for one
            rows = [p for p, _ in marks]
            before = np.concatenate([[0], np.cumsum(counts)])[rows]
            pieces = pa.array(
                np.insert(np.array(pieces.to_pylist(), object), before, [m for _, m in marks]),
                pa.string(),
            )
            counts = counts.copy()
            counts[rows] = 1
        coded = pieces.dictionary_encode()
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        kept, found = self.kept, []
        for piece in coded.dictionary.to_pylist():
            ids = kept.get(piece)
            if ids is None:
                ids = kept[piece] = self._piece(piece)
            found.append(ids)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int64)
        codes = coded.indices.to_numpy()
        ids = gather(np.frombuffer(b"".join(found), "<u4"), offsets, codes)
        per_piece = np.diff(offsets)[codes]
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        part_ends = ends[np.cumsum(counts)]
        per_part = np.diff(part_ends, prepend=0)
        return ids, np.bincount(owner, per_part, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The tokens of each text joined by a space, as a tokenizer without decoder does."""
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pc.binary_join(
            pa.ListArray.from_arrays(pa.array(offsets), self.names.take(pa.array(ids))), " "
        )


def _normalized(text: str) -> str:
    """NFC, then every character in lower case on its own (a final sigma is like others)."""
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


@cache
def _loaded(path: str) -> WordBPE:
    return WordBPE(path)


def _binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), counts.size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())]
    )


def bpe_encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids binary) for every row: token ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids; so has a text of white space. Special
    tokens written out in a text become their ids, as the tokenizers library does by
    default. Repeated rows stay rows, a text of any length is encoded whole, an empty
    table gives none, and other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(tokenizer)
        for part in by_size(batches, most=1 << 20):
            coded = model.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), _binary(*coded)], ["id", "ids"])

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(id, ids, decoded string) for rows (id, ids) as :func:`bpe_encode` makes them.

    No ids, or null, give an empty text.
    """
    ship_package(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(tokenizer)
        for part in by_size(batches, "ids", 1 << 20):
            rows = [x or b"" for x in part.column("ids").to_pylist()]
            counts = np.array([len(x) // 4 for x in rows], np.int64)
            texts = model.decode(np.frombuffer(b"".join(rows), "<u4"), counts)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("ids"), texts], ["id", "ids", "decoded"]
            )

    picked = encoded.select("id", "ids")
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(decode, f"id {kind}, ids binary, decoded string")
