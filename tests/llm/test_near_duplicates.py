"""Fingerprints, SimHash groups and embedding groups against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bindings, common, embedding_dedup, fingerprints, simhash_dedup

SF_DIR = "/root/testdata/sf0.001"


def _components(nodes, linked):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def _simhash(text, shingle=4):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    parts = parts or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_op10_against_brute_force(spark):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in
             bindings.op10_simhash_near_dedup(spark, SF_DIR).collect()}
    prints = {d.doc_id: _simhash(d.text) for d in bindings.documents(spark, SF_DIR).collect()}
    ids = sorted(prints)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
              if (prints[a] ^ prints[b]).bit_count() <= 4]
    groups = _components(ids, linked)
    assert found == {d: (f"{prints[d]:016x}", groups[d]) for d in ids}


@pytest.mark.parametrize("radius", [0, 3, 12])
def test_tiles_link_what_all_pairs_link(spark, radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 3), dtype=np.uint64)
    near = np.bitwise_xor.reduce(flips, axis=1) ^ values[rng.integers(0, 60, 300)]
    values = np.unique(np.concatenate([values, near]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint bigint")
    links = simhash_dedup._tile_links(df, radius, tile_rows=7).collect()
    nodes = values.view(np.int64).tolist()
    close = np.bitwise_count(values[:, None] ^ values) <= radius
    wanted = _components(nodes, [(nodes[i], nodes[j]) for i, j in zip(*np.nonzero(np.triu(close, 1)))])
    assert _components(nodes, [(r.a, r.b) for r in links]) == wanted


def test_simhash_edge_rows(spark):
    docs = spark.createDataFrame(
        [(5, None), (4, ""), (3, " \n"), (7, "a b"), (7, "a b"), (None, "A  B"), (None, "q r s t u")],
        "doc_id bigint, text string",
    ).selectExpr("*", "1 AS fingerprint", "2 AS component_id", "3 AS id")
    found = simhash_dedup.simhash_components(docs)
    got = sorted(map(repr, ((r.id, r.component_id) for r in found.collect())))
    assert got == sorted(map(repr, [(5, 3), (4, 3), (3, 3), (7, 7), (7, 7), (None, 7), (None, None)]))
    assert simhash_dedup.simhash_components(docs.limit(0)).collect() == []
    kept = simhash_dedup.one_per_group(docs).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(
        [repr((3, " \n")), repr((7, "a b")), repr((None, "q r s t u"))]
    )


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, n) for n in range(300, 340)] + [(9, 9)]
    found = common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    nodes = {n for e in edges for n in e} - {9}
    wanted = _components(nodes, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in found.collect()} == wanted


def test_op3_against_brute_force(spark):
    found = {r.doc_id: r for r in bindings.op3_document_fingerprints(spark, SF_DIR).collect()}
    docs = sorted(((d.doc_id, d.text) for d in bindings.documents(spark, SF_DIR).collect()), reverse=True)
    for n, (number, text) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = fingerprints.text_fingerprints([text, edited, following])
        row = found[number]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == own.tobytes().hex()
        assert row.edited_fingerprint == changed.tobytes().hex()
        assert row.near_edited == 1 - int(np.bitwise_count(own ^ changed).sum()) / 128
        assert row.near_next == 1 - int(np.bitwise_count(own ^ after).sum()) / 128
    prints = {n: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for n, r in found.items()}
    every = np.array(list(prints.values()))
    for number, own in prints.items():
        near = int((np.bitwise_count(every ^ own).sum(axis=1) <= 3).sum()) - 1
        assert found[number].n_near == (near if number % 100 == 0 else None)
    nearer = np.mean([r.near_edited > r.near_next for r in found.values()])
    assert nearer > 0.95


def test_edited_texts_of_edge_rows(spark):
    docs = spark.createDataFrame(
        [(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "defgh")], "doc_id bigint, text string"
    ).selectExpr("*", "1 AS part", "2 AS n_chars")
    found = fingerprints.edit_likeness(docs).collect()
    digests = sorted((repr(r.id), r.edited_sha256) for r in found)
    # The first of the equal rows goes on with the other one, that one with an empty text.
    wanted = sorted((repr(n), hashlib.sha256(t.encode()).hexdigest()) for n, t in
                    [(3, "defa "), (2, "a ba "), (2, "a b"), (1, ""), (None, "")])
    assert digests == wanted
    assert fingerprints.edit_likeness(docs.limit(0)).collect() == []


@pytest.mark.parametrize("radius, blocks", [(3, None), (0, None), (5, 6)])
def test_block_tables_find_every_near_fingerprint(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    bits = np.unpackbits(np.repeat(base, 5, axis=0), axis=1)
    for row in bits:
        row[rng.integers(0, 128, rng.integers(0, 7))] ^= 1
    prints = np.packbits(bits, axis=1)
    rows = [(n, p.tobytes().hex()) for n, p in enumerate(prints)] + [(900, None)]
    df = spark.createDataFrame(rows, "id bigint, fingerprint string")
    queries = df.filter("id % 10 = 0")
    pairs = [(r.query_fingerprint, r.fingerprint, r.distance, r.n_rows) for r in
             fingerprints.near_fingerprints(queries, df, radius, blocks).collect()]
    found = set(pairs)
    assert len(pairs) == len(found)  # each by one table only
    times = {}
    for _, text in rows[:-1]:
        times[text] = times.get(text, 0) + 1
    wanted = set()
    for n in range(0, 200, 10):
        for m in range(200):
            apart = int(np.bitwise_count(prints[n] ^ prints[m]).sum())
            if apart <= radius:
                wanted.add((rows[n][1], rows[m][1], apart, times[rows[m][1]]))
    assert found == wanted


def _linked(vectors, threshold=0.95):
    units = vectors.astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    close = units @ units.T >= threshold
    np.fill_diagonal(close, False)
    return close


def test_embeddings_against_brute_force(spark):
    """Groups of every density around the threshold, copies, and rows that link with nothing."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    noise = rng.standard_normal((1200, 16)) * rng.uniform(0.1, 0.4, (1200, 1))
    vectors = (np.repeat(base, 20, axis=0) + noise).astype("f4")
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(vectors)]
    copies = [(2000, rows[5][1]), (2001, rows[5][1])]
    alone = [(2002, None), (2003, []), (2004, [0.0] * 16), (2005, [float("nan")] * 16),
             (2006, [None] * 16), (2007, [float("inf")] * 16), (2008, [1.0] * 3)]
    df = spark.createDataFrame(rows + copies + alone, "vec_id bigint, embedding array<float>")
    df = df.selectExpr("*", "1 AS node", "2 AS links", "3 AS id")
    close = _linked(np.vstack([vectors, vectors[5], vectors[5]]))
    ids = [*range(1200), 2000, 2001]
    groups = _components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(close)))])
    wanted = {n: (int(k), groups[n], groups[n] == n) for n, k in zip(ids, close.sum(axis=1))}
    wanted |= {n: (0, n, True) for n, _ in alone}
    found = embedding_dedup.embedding_components(df, tile_rows=200).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in found} == wanted
    assert embedding_dedup.embedding_components(df.limit(0)).collect() == []


def test_op2_against_brute_force(spark):
    found = {r.vec_id: (r.n_links, r.component_id) for r in
             bindings.op2_embedding_near_dedup(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    close = _linked(np.array([r.embedding for r in rows]))
    ids = [r.vec_id for r in rows]
    groups = _components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(close)))])
    assert found == {n: (int(k), groups[n]) for n, k in zip(ids, close.sum(axis=1))}


def test_window_is_calibrated():
    """Pairs exactly at the threshold miss too many directions as rarely as stated."""
    window = embedding_dedup.calibrated_window(0.95, 48, 2, 0.99)
    rng = np.random.default_rng(0)
    apart = rng.standard_normal((20_000, 48)) * np.sqrt(0.1)
    lost = ((np.abs(apart) > window).sum(axis=1) > 2).mean()
    assert abs(lost - 0.01) < 0.003


def test_rows_go_only_within_one_component(spark):
    """One id with different texts: a clean text stays, a copy of a smaller id's text goes."""
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue pink grey")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, b), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = sorted(tuple(r) for r in simhash_dedup.one_per_group(docs).collect())
    assert kept == [(1, a), (2, b), (3, c)]
    # Near texts of one id: the same one stays in every order of the rows.
    near = spark.createDataFrame([(7, a), (7, b)], "doc_id bigint, text string")
    stay = {tuple(map(tuple, simhash_dedup.one_per_group(d, max_bits=64).collect()))
            for d in (near.repartition(1), near.orderBy(F.desc("text")).coalesce(1))}
    assert len(stay) == 1 and len(next(iter(stay))) == 1
