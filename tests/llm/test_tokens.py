"""Token files and byte-pair encoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tokenizers

from plumbline.llm import bindings, bpe, pieces, token_files

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"
EDGES = [(None, None), (1, ""), (2, "a\n\nb"), (2, "a\n\nb"), (3, "<|endoftext|> x"), (4, "ΣΑΣ é")]


def _odd_texts(seed: int, n: int = 300) -> list[str]:
    rng = random.Random(seed)
    signs = "abc stmdrevl''  \n\t12é́ΣσİßſK漢x!?<|> \x85\x1c 😀AZ½²"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(n)]
    return [t + "<|endoftext|>" + t[::-1] if i % 5 == 0 else t for i, t in enumerate(texts)]


@pytest.mark.parametrize(
    "cut, pattern",
    [
        (pieces.byte_pieces, public_tokenizers.PATTERN),
        (pieces.word_pieces, r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
    ],
)
def test_pieces_equal_the_pattern(cut, pattern):
    texts = [t.lower() for t in _odd_texts(1)]
    found, counts = cut(texts)
    expected = [regex.findall(pattern, t) for t in texts]
    assert counts.tolist() == [len(e) for e in expected]
    assert found.to_pylist() == [p for e in expected for p in e]


def test_word_bpe_equals_the_library():
    library, own = tokenizers.Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    texts = _odd_texts(2)
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    decoded = own.decode(ids, counts).to_pylist()
    for n, text in enumerate(texts):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids[ends[n] - counts[n] : ends[n]].tolist() == wanted, text
        assert decoded[n] == library.decode(wanted, skip_special_tokens=False)


def test_segment_tree_merges_like_a_scan():
    """Against picking the leftmost pair of lowest rank by looking at all pairs."""
    rng = random.Random(3)
    for _ in range(200):
        merges = {}
        for rank in range(12):
            pair = (rng.randint(0, 8), rng.randint(0, 8))
            merges.setdefault(pair, (rank, rng.randint(0, 8)))
        symbols = [rng.randint(0, 8) for _ in range(rng.randint(1, 20))]
        merges = {p: m for p, m in merges.items() if m[1] not in p}
        slow = list(symbols)
        for _ in range(len(symbols)):
            known = [(merges[p][0], i) for i, p in enumerate(zip(slow, slow[1:])) if p in merges]
            if not known:
                break
            _, at = min(known)
            slow[at : at + 2] = [merges[(slow[at], slow[at + 1])][1]]
        assert bpe.merge_pieces(symbols, merges) == slow


def test_one_very_long_word():
    word = "".join(random.Random(4).choices("abcdefghij", k=50_000))
    ids, _ = bpe.WordBPE(WORD).encode([word])
    library = tokenizers.Tokenizer.from_file(WORD)
    assert ids.tolist() == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [None, 0])
def test_bpe_round_trip_of_edge_rows(spark, limit):
    rows = EDGES if limit is None else []
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS id")
    found = bpe.bpe_decode(bpe.bpe_encode(docs, WORD), WORD).collect()
    library = tokenizers.Tokenizer.from_file(WORD)
    expected = []
    for number, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        expected.append((number, raw, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, ((r.id, bytes(r.ids), r.decoded) for r in found))) == sorted(map(repr, expected))


def test_op5_against_the_library(spark):
    library = tokenizers.Tokenizer.from_file(WORD)
    found = {r.doc_id: r for r in bindings.op5_bpe_round_trip(spark, SF_DIR).collect()}
    for doc in bindings.documents(spark, SF_DIR).collect():
        ids = library.encode(doc.text, add_special_tokens=False).ids
        row = found.pop(doc.doc_id)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not found


def test_piece_tokenizer_equals_the_library():
    library, own = tokenizers.Tokenizer.from_file(BYTE), token_files.PieceTokenizer(BYTE)
    texts = _odd_texts(5)
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_op1_against_the_library(spark):
    library = tokenizers.Tokenizer.from_file(BYTE)
    found = {r.doc_id: r for r in bindings.op1_token_files(spark, SF_DIR).collect()}
    start = 0
    for doc in sorted(bindings.documents(spark, SF_DIR).collect()):
        ids = [*library.encode(doc.text, add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        row = found.pop(doc.doc_id)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    assert not found


def test_bundle_of_edge_rows_and_single_documents(spark, tmp_path):
    docs = spark.createDataFrame(EDGES, "doc_id bigint, text string").selectExpr("*", "0 AS part", "0 AS start")
    path = f"{tmp_path}/bundle"
    token_files.write_bundle(docs, path, BYTE, block_bytes=40)
    found = sorted(token_files.read_bundle(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in found] == [None, 1, 2, 2, 3, 4]
    assert [r.start for r in found] == np.cumsum([0, *[len(r.ids) // 4 for r in found[:-1]]]).tolist()
    assert bytes(found[1].ids) == bytes(4) and 50256 in np.frombuffer(found[4].ids, "<u4")
    single = token_files.read_bundle(spark, path, only=[2, 99]).collect()
    assert sorted(r.start for r in single) == [r.start for r in found if r.id == 2]


def test_bundle_without_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    token_files.write_bundle(docs, f"{tmp_path}/empty", BYTE)
    assert token_files.read_bundle(spark, f"{tmp_path}/empty").collect() == []


def test_a_changed_dictionary_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    path = f"{tmp_path}/b"
    token_files.write_bundle(docs, path, BYTE)
    other = spark.createDataFrame([("0" * 64, b"xx", 2)], "dictionary string, data binary, width int")
    other.write.mode("append").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        token_files.read_bundle(spark, path)
