"""Personal data: fixed formats against the plain patterns, and the model on planted spans."""

from __future__ import annotations

import collections
import functools
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from plumbline.llm import bindings, pii

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, base string, spans int"
PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(ds(s)) <= 19 and luhn(ds(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(ds(s)) <= 15),
)


def ds(s):
    return re.sub("[^0-9]", "", s)


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute(text):
    found = [
        (m.start(), k, m.end()) for k, (_, pattern, fits) in enumerate(PLAIN)
        for m in re.finditer(pattern, text or "") if fits(m[0])
    ]
    return sorted(found)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0125()é:", max_size=60))
def test_fixed_formats_are_the_plain_patterns(text):
    assert pii.base_spans(text)[0] == brute(text)


def test_query_against_plain_patterns(spark):
    docs = {d.doc_id: d.text for d in bindings.documents(spark, SF_DIR).collect()}
    rows = {r.doc_id: r for r in bindings.op12_pii(spark, SF_DIR).collect()}
    assert rows.keys() == docs.keys()
    clean = 0
    for number, text in docs.items():
        base, r = brute(text), rows[number]
        counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert set(listed(base).split(",")) <= set(r.spans.split(","))
        clean += not spans
        if not re.search("[0-9@]", text or ""):
            assert not spans
    assert clean > len(docs) / 2


@pytest.fixture(scope="module")
def taught(spark):
    rng = np.random.default_rng(1)
    texts = []
    for n in range(700):
        a, b, c, d = rng.integers(1, 255, 4)
        word = "".join(rng.choice(list("abcdefgh"), 5))
        number = "".join(map(str, rng.integers(0, 10, 15)))
        number += next(x for x in "0123456789" if luhn(number + x))
        texts += [
            f"Write to {word}.{a}@mail{b % 9}.example.com or say {word} at once.",
            f"Server {a}.{b}.{c}.{d} answered, {a}.{b + 300}.{c}.{d} did not.",
            f"Call +1 ({100 + a}) 555-{1000 + n} today, order {n}{a}{b}{c}999.",
            f"Paid with {number} on 2024-0{1 + n % 9}-1{n % 9}, not {number[:-1]}{(int(number[-1]) + 3) % 10}.",
        ]
    return spark.createDataFrame([(n, t, "b", 1) for n, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def model(taught):
    return pii.train_pii(taught)


@pytest.mark.parametrize("text, want", [
    ("please call (201) 555-1234 soon", "(201) 555-1234"),
    ("please call 201-555-1234 soon", "201-555-1234"),
    ("mail bdfga.12 at mail4 dot example dot com please", "bdfga.12 at mail4 dot example dot com"),
    ("mail bdfga.12(at)mail4.example.com please", "bdfga.12(at)mail4.example.com"),
    ("node fe80::1a0:2b1:3c2:4d3 is up", "fe80::1a0:2b1:3c2:4d3"),
])
def test_other_forms_are_added(model, text, want):
    base, spans = model.spans(text)
    assert base == [] and [text[s:e] for s, _, e in spans] == [want]


@pytest.mark.parametrize("text", [
    "we met at noon and talked at length", "on 2024-05-17 it rained", "version 1.2.3 is out",
    "order 7199955512 arrived", "look at it dot", "at 12:30:15:20 sharp", "10.400.3.5 is no host",
])
def test_lookalikes_are_left_alone(model, text):
    assert model.spans(text) == ([], [])


def test_edge_rows(spark, model):
    texts = [None, "", "é" * 3 + " a.b@c.de", "1" * 200_000, "a" * 200_000, "+1" + " " * 100_000, "a.b@c.de a.b@c.de"]
    frame = spark.createDataFrame([(n, t, "b", 1) for n, t in enumerate(texts)] + [(None, "x", "b", 1)], SCHEMA)
    found = {r["id"]: r for r in pii.pii_spans(frame, model).collect()}
    assert found[0]["spans"] == found[1]["spans"] == found[3]["base"] == found[4]["spans"] == []
    assert found[2]["base"] == [(0, 4, 12)] and len(found[6]["base"]) == 2 and found[None]["spans"] == []
    redacted = {r.doc_id: r for r in pii.redact_pii(frame, model).collect()}
    assert redacted[0].text is None and redacted[2].text == "ééé [email]" and redacted[2].base == "b"
    assert pii.pii_spans(frame.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "plain words", "b", 1), (2, None, "b", 1)], SCHEMA)
    for docs in (frame, frame.limit(0)):
        assert pii.train_pii(docs) == pii.PiiModel(None, {})
    base, spans = pii.PiiModel(None, {}).spans("a.b@c.de")
    assert base == spans == [(0, 0, 8)]


def test_trees_fit_and_thresholds_hold_their_precision():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 200, (3000, 4)).astype(np.uint8)
    y = ((x[:, 0] > 90) ^ (x[:, 2] > 120)).astype(float)
    scores = pii.fit_trees(x, y).scores(x)
    assert ((scores > 0.5) == y).mean() > 0.98
    noisy = np.where(rng.random(3000) < 0.1, 1 - y, y)
    once = np.ones(3000)
    threshold = pii.calibrated_threshold(scores, noisy, once, 0.9)
    assert noisy[scores >= threshold].mean() >= 0.9
    assert pii.calibrated_threshold(scores, np.zeros(3000), once, 0.9) == 2.0


def test_all_examples_are_learned_from(taught, monkeypatch):
    """About per_label of each kind and label were taken, and a fourth of them set thresholds."""
    seen = collections.Counter(
        (label, row.tobytes()) for r in taught.collect() for label, row in pii.examples(r.text))
    kept = []

    def boosted(held, starts, **options):
        kept.append(held)
        return found(held, starts, **options)

    found = pii.boosted
    monkeypatch.setattr(pii, "boosted", boosted)
    model = pii.train_pii(taught, per_label=20)
    held = kept[0]
    rows = {(int(label), x.tobytes()): n for label, x, n in zip(held.label, held.x, held.times)}
    assert rows == dict(seen) and len(rows) > 500
    weight = {}
    for x, label, w in zip(held.x, held.label, held.weight):
        weight[x[0], label] = weight.get((x[0], label), 0) + w
    assert max(weight.values()) < 20.001
    counted = [np.concatenate(c) for c in zip(*held.unseen_counts())]
    assert counted[3].sum() == sum(seen.values())
    text = "please call (201) 555-1234 soon"
    assert [text[s:e] for s, _, e in model.spans(text)[1]] == ["(201) 555-1234"]


def test_a_fit_in_parts_is_the_fit_on_the_driver(taught, monkeypatch):
    few = taught.filter("doc_id < 400")
    monkeypatch.setattr(pii, "boosted", functools.partial(pii.boosted, trees=7))
    whole = pii.train_pii(few)
    monkeypatch.setattr(pii, "_ROWS_AT_ONCE", 150)
    monkeypatch.setattr(pii, "_TREES_AT_ONCE", 3)
    parts = pii.train_pii(few)
    assert parts.thresholds == whole.thresholds and len(whole.trees.leaves) == 7
    assert parts.trees.start == whole.trees.start
    for a, b in zip(parts.trees.splits + parts.trees.leaves, whole.trees.splits + whole.trees.leaves):
        assert np.array_equal(a, b)
