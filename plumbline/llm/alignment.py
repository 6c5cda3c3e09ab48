"""Aligning two tokenizers' tokens of a text, and counting which tokens meet.

Both tokenizers spell the same bytes. Where a token of each ends at the same byte, the
text is cut into groups; every token of one side in a group is linked with every token of
the other. The shorter list of ends drives: from the match before, steps that double find
where its next end must lie in the longer list, and halving finds the place.

What grows with the corpus stays distributed. Texts become blocks of some megabytes: the
block's different linked pairs, and which document has which of them how often, packed.
Pairs are counted over blocks, and each block asks once for each of its pairs, however many
of its documents hold it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import by_size, id_and_text, packed_planes, unpacked_planes, written
from plumbline.llm.pieces import gather, space_pieces
from plumbline.llm.token_files import PieceTokenizer

_LANE = 64
#: Bytes of text that are aligned at once, links that are counted at once, and pieces that
#: a worker keeps in each of its two tables. They bound a worker's memory, not the result.
_TEXT_AT_ONCE = 1 << 20
_LINKS_AT_ONCE = 1 << 20
_KEPT_PIECES = 250_000


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All entries end to end, and where each begins."""
    return np.frombuffer(b"".join(entries), np.uint8), _offsets([len(e) for e in entries])


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary.

    Printable bytes stand for themselves; the others have letters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def byte_level_entries(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary; entries in other letters are UTF-8."""
    letters = byte_letters()
    entries = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, number in vocabulary.items():
        known = all(c in letters for c in token)
        entries[number] = bytes(letters[c] for c in token) if known else token.encode()
    return entries


def piece_entries(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of every piece: U+2581 is a space, and a byte piece its byte."""
    pieces = [model.id_to_piece(n) for n in range(model.get_piece_size())]
    return [
        bytes([int(piece[3:5], 16)]) if model.is_byte(n) else piece.replace("▁", " ").encode()
        for n, piece in enumerate(pieces)
    ]


def spells_spaces_apart(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether a run of spaces, with what follows it, has the same tokens in any text.

    That is so if texts are taken as they are and no piece has a space after something
    else, since merges then can't cross the place before a run. False if the model can't
    be read.
    """
    try:
        from sentencepiece import sentencepiece_model_pb2 as parts
    except (ImportError, TypeError):  # it needs the protobuf package
        return False
    spec = parts.ModelProto.FromString(model.serialized_model_proto())
    text, trained = spec.normalizer_spec, spec.trainer_spec
    return (
        trained.model_type == parts.TrainerSpec.BPE and trained.byte_fallback
        and not trained.treat_whitespace_as_suffix
        and text.add_dummy_prefix and text.escape_whitespaces
        and not text.remove_extra_whitespaces and not text.precompiled_charsmap
        and not any(re.search("[^▁]▁", piece.piece) for piece in spec.pieces)
    )


class SpacedTokenizer:
    """A piece model that meets each different run of spaces with what follows it once."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.apart = spells_spaces_apart(self.library)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(texts, num_threads=1)
        offsets = _offsets(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1])), offsets

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as the model gives them for the whole text."""
        # The model takes the letter it writes for a space as one, which the cut does not.
        whole = [not self.apart or "▁" in text for text in texts]
        pieces, counts = space_pieces(["" if w else text for w, text in zip(whole, texts)])
        coded = pieces.dictionary_encode()
        # The model puts a space before every text itself.
        different = [piece[1:] for piece in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat, offsets = self._flat(different)
        codes = coded.indices.to_numpy()
        ids = gather(flat, offsets, codes)
        ends = _offsets(np.diff(offsets)[codes])[_offsets(counts)].tolist()
        split = [ids[a:b] for a, b in zip(ends, ends[1:])]
        rows = np.flatnonzero(whole).tolist()
        ids, offsets = self._flat([texts[row] for row in rows])
        for n, row in enumerate(rows):
            split[row] = ids[offsets[n] : offsets[n + 1]]
        return split


def gallop(
    short: np.ndarray, long: np.ndarray, lanes: np.ndarray, low: np.ndarray, high: np.ndarray
) -> np.ndarray:
    """Where in ``long`` the first value not below each value of ``short`` is.

    Lane n holds short[lanes[n]:lanes[n + 1]], ascending, and its values are looked for in
    long[low[n]:high[n]]. All lanes advance together, one value at a time: the search
    begins where the lane's last one ended, doubles its step until it has passed the
    value, and halves what lies between.
    """
    found = np.empty(short.size, np.int64)
    sizes = np.diff(lanes)
    order = np.argsort(-sizes, kind="stable")
    first, sizes, at, top = lanes[:-1][order], sizes[order], low[order].copy(), high[order]
    live = sizes.size
    for turn in range(int(sizes.max(initial=0))):
        live = np.searchsorted(-sizes[:live], -turn, "left")  # lanes longer than turn
        place = first[:live] + turn
        value = short[place]
        left, right = at[:live], top[:live].copy()
        rows, step = np.arange(live), 1
        while rows.size:
            probe = left[rows] + step - 1
            inside = probe < top[rows]
            rows, probe = rows[inside], probe[inside]
            below = long[probe] < value[rows]
            right[rows[~below]] = probe[~below]
            rows = rows[below]
            left[rows] = probe[below] + 1
            step *= 2
        rows = np.flatnonzero(left < right)
        while rows.size:
            middle = (left[rows] + right[rows]) // 2
            below = long[middle] < value[rows]
            left[rows[below]] = middle[below] + 1
            right[rows[~below]] = middle[~below]
            rows = rows[left[rows] < right[rows]]
        found[place] = left
    return found


def common_ends(
    a_ends: np.ndarray, b_ends: np.ndarray, a_docs: np.ndarray, b_docs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both lists of the ends they share, in ascending order.

    ``a_docs`` and ``b_docs`` are where each document begins in the lists, with their
    lengths last. In every document the list with fewer ends drives the search.
    """
    parts = []
    a_drives = np.diff(a_docs) <= np.diff(b_docs)
    for drives, short, long, mine, theirs in (
        (a_drives, a_ends, b_ends, a_docs, b_docs), (~a_drives, b_ends, a_ends, b_docs, a_docs)
    ):
        docs = np.flatnonzero(drives)
        sizes = np.diff(mine)[docs]
        picked = gather(np.arange(short.size), mine, docs)
        # Lanes of a bounded number of values, so that a long document has many.
        lanes_of = -(-sizes // _LANE)
        lane_doc = np.repeat(docs, lanes_of)
        number = np.arange(lane_doc.size) - np.repeat(_offsets(lanes_of)[:-1], lanes_of)
        begins = np.repeat(_offsets(sizes)[:-1], lanes_of) + number * _LANE
        lanes = np.append(begins, picked.size)
        values = short[picked]
        rank = gallop(values, long, lanes, theirs[lane_doc], theirs[lane_doc + 1])
        inside = rank < np.repeat(theirs[1:][docs], sizes)
        hit = inside.copy()
        hit[inside] = long[rank[inside]] == values[inside]
        parts.append((picked[hit], rank[hit]) if drives is a_drives else (rank[hit], picked[hit]))
    a = np.concatenate([parts[0][0], parts[1][0]])
    b = np.concatenate([parts[0][1], parts[1][1]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


@dataclass
class Aligned:
    """Documents end to end: their ids, where documents begin, and where groups begin."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_docs: np.ndarray
    b_docs: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    group_docs: np.ndarray


class Aligner:
    def __init__(self, byte_level: str, piece_model: str):
        self.a = PieceTokenizer(byte_level, special_as_text=True, most_kept=_KEPT_PIECES)
        self.b = SpacedTokenizer(piece_model)
        a_entries = byte_level_entries(self.a.library.get_vocab())
        b_entries = piece_entries(self.b.library)
        self.a_bytes, self.a_at = _table(a_entries)
        self.b_bytes, self.b_at = _table(b_entries)
        self.a_size, self.b_size = len(a_entries), len(b_entries)
        # Every id behind each mark that may stand before it, first A's, then B's.
        self.marked = pa.array(
            [f"{mark}{n}" for size, marks in ((self.a_size, ",;"), (self.b_size, ",|"))
             for mark in marks for n in range(size)]
        )

    def align(self, texts: list[str]) -> Aligned:
        """Texts whose tokens don't spell space + text on both sides get no tokens."""
        a = self.a.encode([" " + text if text else "" for text in texts])
        b = self.b.encode(texts)
        ids, docs = [], []
        for found, flat, at in ((a, self.a_bytes, self.a_at), (b, self.b_bytes, self.b_at)):
            every = np.concatenate([*found, []]).astype(np.int64)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            spelled = gather(flat, at, every).tobytes()
            ends = _offsets(np.diff(at)[every])[_offsets(counts)]
            ids.append(every)
            docs.append((counts, spelled, ends))
        kept = np.zeros(len(texts), bool)
        for n, text in enumerate(texts):
            if text:
                want = b" " + text.encode("utf-8", "surrogatepass")
                kept[n] = all(s[e[n] : e[n + 1]] == want for _, s, e in docs)
        for side, (counts, _, _) in enumerate(docs):
            if not kept.all():
                ids[side] = ids[side][np.repeat(kept, counts)]
                docs[side] = (np.where(kept, counts, 0),)
        a_docs, b_docs = (_offsets(d[0]) for d in docs)
        a_ends = np.cumsum(np.diff(self.a_at)[ids[0]])
        b_ends = np.cumsum(np.diff(self.b_at)[ids[1]])
        a_cut, b_cut = common_ends(a_ends, b_ends, a_docs, b_docs)
        return Aligned(
            *ids, a_docs, b_docs, np.append(0, a_cut + 1), np.append(0, b_cut + 1),
            np.searchsorted(a_cut + 1, a_docs, "right") * (a_docs > 0),
        )

    def spelled_groups(self, found: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every document, nothing for one without tokens."""
        a_first, b_first = np.zeros(found.a_ids.size, bool), np.zeros(found.b_ids.size, bool)
        a_first[found.a_groups[:-1]] = b_first[found.b_groups[:-1]] = True
        groups = np.arange(found.a_groups.size - 1)
        a_group = np.repeat(groups, np.diff(found.a_groups))
        b_group = np.repeat(groups, np.diff(found.b_groups))
        # Tokens stand group by group, those of A before those of B.
        codes = np.empty(a_group.size + b_group.size, np.int32)
        codes[np.arange(a_group.size) + found.b_groups[a_group]] = found.a_ids + a_first * self.a_size
        codes[np.arange(b_group.size) + found.a_groups[b_group + 1]] = (
            2 * self.a_size + found.b_ids + b_first * self.b_size
        )
        spelled = self.marked.take(pa.array(codes))
        if not codes.size:
            return [b""] * (found.a_docs.size - 1)
        ends = np.frombuffer(spelled.buffers()[1], np.int32)[found.a_docs + found.b_docs].tolist()
        data = memoryview(spelled.buffers()[2])
        # A document's first mark, before its first group, is left out.
        return [bytes(data[x + 1 : y]) for x, y in zip(ends, ends[1:])]

    def linked_pairs(self, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, a * size of b + b, how often) of every different linked pair.

        Links are spelled out so many at a time and then counted, so a large group takes
        memory for its different pairs only.
        """
        a_sizes, b_sizes = np.diff(found.a_groups), np.diff(found.b_groups)
        links = _offsets(a_sizes * b_sizes)
        doc_of_group = np.repeat(np.arange(found.group_docs.size - 1), np.diff(found.group_docs))
        width = np.int64(self.b_size)
        size = np.int64(self.a_size) * width
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, int(links[-1]), _LINKS_AT_ONCE):
            link = np.arange(start, min(start + _LINKS_AT_ONCE, int(links[-1])))
            group = np.searchsorted(links, link, "right") - 1
            inner = link - links[group]
            a = found.a_ids[found.a_groups[group] + inner // b_sizes[group]]
            b = found.b_ids[found.b_groups[group] + inner % b_sizes[group]]
            new, count = np.unique(doc_of_group[group] * size + a * width + b, return_counts=True)
            if keys.size:
                merged, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                added = np.bincount(inverse, np.concatenate([times, count]), merged.size)
                keys, times = merged, added.astype(np.int64)
            else:
                keys, times = new, count
        return keys // size, keys % size, times


@cache
def _aligner(byte_level: str, piece_model: str) -> Aligner:
    # A task has one core; threads of the library's own would each keep memory they freed.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(byte_level, piece_model)


def aligned_groups(
    docs: DataFrame, byte_level: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, a_ids, b_ids, a_begins, b_begins): every document's tokens and its groups.

    Group n of a document holds the tokens from a_begins[n] and b_begins[n] on, up to where
    the next one begins. Documents without tokens (null and empty texts, and those that a
    side can't spell) have empty arrays. Rows and ids are kept as they are; an empty table
    gives no rows; other columns are not read.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _aligner(byte_level, piece_model)
        for part in by_size(batches, most=_TEXT_AT_ONCE):
            found = model.align(part.column("text").to_pylist())
            columns = [part.column("id")]
            for ids, at in ((found.a_ids, found.a_docs), (found.b_ids, found.b_docs)):
                columns.append(pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32)))
            for begins, at in ((found.a_groups, found.a_docs), (found.b_groups, found.b_docs)):
                within = begins[:-1] - np.repeat(at[:-1], np.diff(found.group_docs))
                columns.append(pa.ListArray.from_arrays(
                    found.group_docs.astype(np.int32), within.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "a_ids", "b_ids", "a_begins", "b_begins"])

    return source.mapInArrow(
        align,
        f"id {kind}, a_ids array<int>, b_ids array<int>, a_begins array<int>, b_begins array<int>",
    )


_BLOCK = (
    "block bigint, ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
    "n_links array<bigint>, groups_sha256 array<string>, pairs array<bigint>, "
    "pair_docs array<bigint>, sizes binary, which binary, times binary"
)


class _Block:
    """Documents gathered until they are one row: what they hold, pair by pair."""

    def __init__(self) -> None:
        self.ids: list = []
        self.facts: dict[str, list] = {
            "n_a": [], "n_b": [], "n_groups": [], "n_links": [], "groups_sha256": [],
        }
        self.docs: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, model: Aligner, ids: list, texts: list[str]) -> None:
        found = model.align(texts)
        doc, pair, times = model.linked_pairs(found)
        groups = np.diff(found.group_docs)
        links = _offsets(np.diff(found.a_groups) * np.diff(found.b_groups))
        self.facts["n_a"] += np.diff(found.a_docs).tolist()
        self.facts["n_b"] += np.diff(found.b_docs).tolist()
        self.facts["n_groups"] += groups.tolist()
        self.facts["n_links"] += np.diff(links[found.group_docs]).tolist()
        self.facts["groups_sha256"] += [
            hashlib.sha256(s).hexdigest() if s else "" for s in model.spelled_groups(found)
        ]
        self.docs.append(np.bincount(doc, minlength=len(ids)))
        self.pairs.append(pair)
        self.times.append(times)
        self.ids += ids

    def row(self, number: int) -> dict:
        pairs, which = np.unique(np.concatenate([*self.pairs, []]).astype(np.int64), return_inverse=True)
        return {
            "block": [number], "ids": [self.ids], **{k: [v] for k, v in self.facts.items()},
            "pairs": [pairs], "pair_docs": [np.bincount(which, minlength=pairs.size)],
            "sizes": [packed_planes(np.concatenate(self.docs).astype("<u4"))],
            "which": [packed_planes(which.astype("<u4"))],
            "times": [packed_planes(np.concatenate([*self.times, []]).astype("<u8"))],
        }


def token_blocks(
    docs: DataFrame, byte_level: str, piece_model: str, id_col: str = "doc_id",
    text_col: str = "text", block_bytes: int = 1 << 23,
) -> DataFrame:
    """The documents as blocks of about ``block_bytes`` of text, written to the shared folder."""
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType

    def gather_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _aligner(byte_level, piece_model)
        schema = None
        part, number, block, held = TaskContext.get().partitionId(), 0, _Block(), 0
        for some in by_size(batches, most=_TEXT_AT_ONCE):
            schema = schema or _block_schema(some.schema.field("id").type)
            block.add(model, some.column("id").to_pylist(), some.column("text").to_pylist())
            held += some.column("text").nbytes
            if held >= block_bytes:
                yield pa.RecordBatch.from_pydict(block.row((part << 33) + number), schema=schema)
                number, block, held = number + 1, _Block(), 0
        if block.ids:
            yield pa.RecordBatch.from_pydict(block.row((part << 33) + number), schema=schema)

    return written(
        source.mapInArrow(gather_blocks, _BLOCK.format(id=kind.simpleString())), "blocks"
    )


def _block_schema(id_type: pa.DataType) -> pa.Schema:
    many = pa.list_(pa.int64())
    return pa.schema([
        ("block", pa.int64()), ("ids", pa.list_(id_type)), ("n_a", many), ("n_b", many),
        ("n_groups", many), ("n_links", many), ("groups_sha256", pa.list_(pa.string())),
        ("pairs", many), ("pair_docs", many), ("sizes", pa.binary()), ("which", pa.binary()),
        ("times", pa.binary()),
    ])


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): in how many documents each pair is linked, and whether no pair
    with its A id is in more. There are no more rows than pairs of vocabulary entries."""
    counted = (
        blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("docs"))
    )
    counted = written(counted, "pairs")
    most = counted.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("docs").alias("most"))
    return counted.withColumn("a", F.floor(F.col("pair") / width)).join(most, "a").select(
        "pair", "docs", (F.col("docs") == F.col("most")).alias("best")
    )


def link_counts(
    docs: DataFrame, byte_level: str, piece_model: str, id_col: str = "doc_id",
    text_col: str = "text", block_bytes: int = 1 << 23,
) -> DataFrame:
    """How the tokens of both tokenizers meet in every document, and how usual that is.

    (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): tokens of each
    side, groups, links (pairs of token occurrences in one group), links whose pair of ids
    is in as many documents as any with the same A id, the sum over links of that number of
    documents, and a digest of the groups. A is the byte-level tokenizer on space + text,
    B the piece model on the text; strings of special tokens are plain text.

    Null and empty texts, and texts whose tokens don't spell space + text on both sides,
    have zeros and an empty digest. Rows are documents: repeated rows count each, null ids
    stay. An empty table gives no rows; other columns are not read. Runs jobs.
    """
    blocks = token_blocks(docs, byte_level, piece_model, id_col, text_col, block_bytes)
    width = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    # The asked rows must not be broadcast: Spark takes their number for the blocks'.
    answers = asked.hint("shuffle_merge").join(pair_counts(blocks, width), "pair").select(
        F.col("block").alias("of"), "place", "docs", "best"
    )
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    facts = ["n_a", "n_b", "n_groups", "n_links"]

    def add_up(key: tuple, block: pa.Table, answer: pa.Table) -> pa.Table:
        row = {name: block.column(name).combine_chunks()[0] for name in block.column_names}
        place = answer.column("place").to_numpy()
        counts, best = np.zeros(place.size, np.int64), np.zeros(place.size, np.int64)
        counts[place] = answer.column("docs").to_numpy()
        best[place] = answer.column("best").to_numpy().astype(np.int64)
        which = unpacked_planes(row["which"].as_py(), "<u4")
        times = unpacked_planes(row["times"].as_py(), "<u8").astype(np.int64)
        at = _offsets(unpacked_planes(row["sizes"].as_py(), "<u4"))
        sums = [np.diff(_offsets(times * values[which])[at]) for values in (best, counts)]
        return pa.table({
            "id": row["ids"].values, **{name: row[name].values for name in facts},
            "n_best": sums[0], "count_sum": sums[1], "groups_sha256": row["groups_sha256"].values,
        })

    kept = blocks.select("block", "ids", *facts, "groups_sha256", "sizes", "which", "times")
    return kept.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        add_up,
        f"id {kind}, " + ", ".join(f"{name} bigint" for name in (*facts, "n_best", "count_sum"))
        + ", groups_sha256 string",
    )
