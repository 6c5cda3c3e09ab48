"""Whitening against numpy on the same integers, with its edge cases."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm.bindings import component_rows
from plumbline.llm.whitening import (
    deviations, principal_components, squared_lengths, whiten_vectors,
)

SCHEMA = "vec_id bigint, embedding array<float>, `key` string, n int"


def frame(spark, vectors):
    rows = [(k, v, "x", 7) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, weights=None, components=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit, counts = np.unique(x, axis=0, return_counts=True)
    w = np.ones(len(fit), np.int64) if weights is None else counts
    n, s = int(w.sum()), (fit * w[:, None]).sum(axis=0)
    z = (n * fit - s) / n
    values, axes = np.linalg.eigh((z * w[:, None]).T @ z / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    d = n * x - s
    return n, (d * d).sum(axis=1), d / n @ axes / np.sqrt(values), values / np.trace(z.T @ (z * w[:, None]) / n)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_matches_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 6)) * [0.2, 0.5, 1, 2, 3, 5]
    vectors = [*base.tolist(), *[base[0].tolist()] * 60, *base[5:40].tolist()]
    n, deviation, white, explained = brute(vectors, None if weights == "one" else 1, 4)
    found = whiten_vectors(frame(spark, vectors), components=4, weights=weights).orderBy("id").collect()
    assert [r["id"] for r in found] == list(range(len(vectors)))
    assert {r["n"] for r in found} == {n} and n == (150 if weights == "one" else 245)
    assert [int(r["deviation"]) for r in found] == deviation.tolist()
    got = np.array([r["whitened"] for r in found])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-9
    assert np.allclose(found[0]["explained"], explained, rtol=1e-9)
    assert found[0]["identity_error"] < 1e-9


def test_query_rows(spark):
    rng = np.random.default_rng(4)
    rows = component_rows(whiten_vectors(frame(spark, rng.standard_normal((40, 20)).tolist())))
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = rows.groupBy("vec_id").agg({"component": "max"}).collect()
    assert len(got) == 40 and {r[1] for r in got} == {16}


def test_unusable_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [3e38, 0.0],
               [0.1, 0.2], [0.3, -0.2], [-0.5, 0.9], [0.1, 0.2]]
    found = whiten_vectors(frame(spark, vectors)).collect()
    assert sorted(r["id"] for r in found) == [6, 7, 8, 9]
    assert {r["n"] for r in found} == {3}
    same = {r["id"]: r["whitened"] for r in found}
    assert same[6] == same[9]


def test_lengths_are_fitted_apart_and_flat_components_are_null(spark):
    vectors = [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [5.0], [5.0]]
    found = {r["id"]: r for r in whiten_vectors(frame(spark, vectors)).collect()}
    assert found[0]["n"] == 3 and found[3]["n"] == 1
    assert found[0]["whitened"][1] is None and found[0]["explained"] == [1.0, 0.0]
    assert abs(abs(found[0]["whitened"][0]) - 1.5**0.5) < 1e-12
    assert found[3]["whitened"] == [None] and found[3]["explained"] == [None]
    assert found[3]["deviation"] == 0 and found[3]["identity_error"] is None


def test_empty_table(spark):
    assert whiten_vectors(frame(spark, [])).collect() == []


def test_null_and_repeated_ids_stay_rows(spark):
    rows = [(None, [0.5, 1.0], "a", 1), (1, [1.0, 2.0], "a", 1), (1, [1.0, 2.0], "a", 1), (1, [3.0, 1.0], "a", 1)]
    found = whiten_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["id"] or 0 for r in found) == [0, 1, 1, 1]


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2**52, -(2**52)], [5, 7]], np.int64)
    n = 3 * 10**12
    sums = [int(x[:, 0].sum()) * 10**12, int(x[:, 1].sum()) * 10**12]
    want = [[n * int(a) - s for a, s in zip(row, sums)] for row in x]
    d = deviations(x, n, sums)
    assert d.tolist() == want
    assert squared_lengths(d) == [sum(v * v for v in row) for row in want]


def test_small_eigenvalues_keep_their_share():
    rng = np.random.default_rng(5)
    z = rng.standard_normal((400, 5)) * [1e4, 1, 1e-1, 1e-2, 1e-3]
    values, projection, explained = principal_components(z.T @ z / 400, 5)
    white = z @ projection
    assert np.abs(white.T @ white / 400 - np.eye(5)).max() < 1e-4
    assert Fraction(sum(explained)).limit_denominator(1000) == 1
