"""Cross-tokenizer alignment against a plain version of every step."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import alignment, bindings, token_files

SF_DIR = "/root/testdata/sf0.001"
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, block int, pair string"


def brute_groups(text, a, b, a_bytes):
    """Groups of (A ids, B ids), or nothing if a side does not spell space + text."""
    if not text:
        return []
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    spelled_a = [a_bytes[n] for n in a_ids]
    spelled_b = [
        bytes([int(b.id_to_piece(n)[3:5], 16)]) if b.is_byte(n)
        else b.id_to_piece(n).replace("▁", " ").encode() for n in b_ids
    ]
    want = b" " + text.encode()
    if b"".join(spelled_a) != want or b"".join(spelled_b) != want:
        return []
    groups, i, j = [], 0, 0
    while i < len(a_ids):
        i0, j0 = i, j
        left, right = len(spelled_a[i]), len(spelled_b[j])
        i, j = i + 1, j + 1
        while left != right:
            if left < right:
                left, i = left + len(spelled_a[i]), i + 1
            else:
                right, j = right + len(spelled_b[j]), j + 1
        groups.append((a_ids[i0:i], b_ids[j0:j]))
    return groups


def brute(texts):
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_bytes = alignment.byte_level_entries(a.get_vocab())
    every = [brute_groups(t, a, b, a_bytes) for t in texts]
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in every]
    docs = Counter(p for found in links for p in found)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    rows = []
    for groups, found in zip(every, links):
        listed = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups),
            sum(found.values()), sum(n for p, n in found.items() if docs[p] == most[p[0]]),
            sum(n * docs[p] for p, n in found.items()),
            hashlib.sha256(listed.encode()).hexdigest() if groups else "",
        ))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "a", "the cat sat", "the cat sat", "  two  spaces\n\n\ttabs  ", "<|endoftext|> here",
    "<s> a </s> <unk> <0x41>", "▁ already", "naïve café ñandú 日本語 😀", "x" * 3000, "\x00\x01 nul",
    "8b540ef2c226668020056c2469c653445539f8d7", "aé" * 700, "don't 123 4567 ... ###",
]


def test_edge_texts(spark):
    frame = spark.createDataFrame([(n, t, 1, "p") for n, t in enumerate(TEXTS)], SCHEMA)
    for size in (1, 1 << 23):
        found = alignment.link_counts(frame, BYTE_LEVEL, PIECES, block_bytes=size)
        rows = {r["id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
        assert rows == dict(enumerate(brute(TEXTS)))
    assert rows[0] == rows[1] == (0, 0, 0, 0, 0, 0, "")
    assert rows[9][-1] == ""


def test_whole_table(spark):
    docs = bindings.documents(spark, SF_DIR).collect()
    want = {d.doc_id: row for d, row in zip(docs, brute([d.text for d in docs]))}
    found = bindings.op13_tokenizer_alignment(spark, SF_DIR)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.collect()} == want


def test_null_and_repeated_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "ab cd", 1, "p"), (4, "ab cd", 1, "p"), (4, "ab cd", 1, "p")], SCHEMA)
    found = alignment.link_counts(frame, BYTE_LEVEL, PIECES).collect()
    assert sorted(r["id"] or 0 for r in found) == [0, 4, 4]
    assert all(r["count_sum"] == 3 * r["n_links"] and r["n_best"] == r["n_links"] for r in found)
    assert alignment.link_counts(frame.limit(0), BYTE_LEVEL, PIECES).collect() == []


def test_groups_of_documents(spark):
    frame = spark.createDataFrame([(n, t, 1, "p") for n, t in enumerate(TEXTS)], SCHEMA)
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    entries = alignment.byte_level_entries(a.get_vocab())
    for r in alignment.aligned_groups(frame, BYTE_LEVEL, PIECES).collect():
        cut = [
            (r["a_ids"][i:i2], r["b_ids"][j:j2]) for i, i2, j, j2 in zip(
                r["a_begins"], [*r["a_begins"][1:], len(r["a_ids"])],
                r["b_begins"], [*r["b_begins"][1:], len(r["b_ids"])])
        ]
        assert cut == brute_groups(TEXTS[r["id"]], a, b, entries)


ends = st.lists(st.integers(1, 6), min_size=0, max_size=300)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ends, ends), min_size=1, max_size=5))
def test_galloping_finds_the_shared_ends(docs):
    a, b, a_docs, b_docs, base = [], [], [0], [0], 0
    for left, right in docs:
        a += [base + x for x in np.cumsum(left).tolist()]
        b += [base + x for x in np.cumsum(right).tolist()]
        a_docs.append(len(a))
        b_docs.append(len(b))
        base += 10_000
    i, j = alignment.common_ends(
        np.array(a, np.int64), np.array(b, np.int64), np.array(a_docs), np.array(b_docs))
    both = sorted(set(a) & set(b))
    assert [a[k] for k in i] == both and [b[k] for k in j] == both


def test_links_are_counted_alike_in_small_parts(monkeypatch):
    model = alignment.Aligner(BYTE_LEVEL, PIECES)
    found = model.align([t or "" for t in TEXTS])
    whole = [x.tolist() for x in model.linked_pairs(found)]
    monkeypatch.setattr(alignment, "_LINKS_AT_ONCE", 7)
    assert [x.tolist() for x in model.linked_pairs(found)] == whole


def test_blocks_are_packed(spark):
    # A block is one row, so what it holds is in the JVM's memory several times.
    texts = [" ".join(f"w{n % 7} {n * i % 1000} {'ab' * (n % 5)}" for n in range(400)) for i in range(60)]
    model = alignment.Aligner(BYTE_LEVEL, PIECES)
    entries = model.linked_pairs(model.align(texts))[0].size
    frame = spark.createDataFrame([(n, t, 1, "p") for n, t in enumerate(texts)], SCHEMA).coalesce(1)
    blocks = alignment.token_blocks(frame, BYTE_LEVEL, PIECES)
    held = blocks.agg(F.sum(F.octet_length("which") + F.octet_length("times"))).first()[0]
    assert held < 4 * entries


def test_few_pieces_reach_the_library_at_once(monkeypatch):
    texts = [" ".join(f"{n}x{i}" for n in range(50)) for i in range(40)] + [t or "" for t in TEXTS]
    want = [x.tolist() for x in token_files.PieceTokenizer(BYTE_LEVEL, special_as_text=True).encode(texts)]
    monkeypatch.setattr(token_files, "_PIECES_AT_ONCE", 3, raising=False)
    model = alignment.Aligner(BYTE_LEVEL, PIECES)
    library, sizes = model.a.by_piece, []

    class Counted:
        def encode_batch_fast(self, some, **how):
            sizes.append(len(some))
            return library.encode_batch_fast(some, **how)

    model.a.by_piece = Counted()
    assert [x.tolist() for x in model.a.encode(texts)] == want
    assert max(sizes) == 3


def test_few_kept_pieces_change_no_ids():
    small = token_files.PieceTokenizer(BYTE_LEVEL, special_as_text=True, most_kept=5)
    texts = [t or "" for t in TEXTS] * 2
    library = small.library
    library.encode_special_tokens = True
    for text in texts:
        assert small.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(small.kept) + len(small.older) < 30


def test_runs_of_spaces_are_spelled_as_in_the_whole_text():
    own = alignment.SpacedTokenizer(PIECES)
    assert own.apart
    texts = [t or "" for t in TEXTS] + ["a ", " a", "a  ", "  a  b ", "a\n b", "a \n", "▁ a ▁b", "a\u3000b \u0301c"]
    assert [x.tolist() for x in own.encode(texts)] == own.library.encode(texts)
    assert own.encode([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("  ab▁é日\n\t.<s>\u3000\x00😀"), max_size=30), max_size=6))
def test_any_text_is_spelled_as_by_the_library(texts):
    own = _spaced()
    assert [x.tolist() for x in own.encode(texts)] == own.library.encode(texts)


def test_a_model_that_joins_words_gets_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "spells_spaces_apart", lambda model: False)
    own = alignment.SpacedTokenizer(PIECES)
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in own.encode(texts)] == own.library.encode(texts)


@cache
def _spaced():
    return alignment.SpacedTokenizer(PIECES)
