"""Quality, language and probability models: brute force and held-out accuracy."""

from __future__ import annotations

import collections
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm import bindings, language, quality, scoring

SF_DIR = "/root/testdata/sf0.01"
EDGES = [(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "x" * 700), (4, "\n\n")]
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _held_out(number, parts, rest):
    return zlib.crc32(str(number).encode()) % parts == rest


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id bigint, text string").selectExpr(
        "*", "1 AS score", "2 AS id", "3 AS held_out"
    )


def test_chain_marginals_equal_all_labelings():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=5).tolist()
    start, move = tuple(np.exp(rng.normal(size=2))), tuple(np.exp(rng.normal(size=4)))
    total, good, moves = 0.0, np.zeros(5), np.zeros(4)
    for labels in itertools.product((0, 1), repeat=5):
        steps = [2 * a + b for a, b in zip(labels, labels[1:])]
        weight = start[labels[0]] * math.exp(sum(s for s, y in zip(scores, labels) if y))
        weight *= math.prod(move[s] for s in steps)
        total += weight
        good += weight * np.array(labels)
        moves += weight * np.bincount(steps, minlength=4)
    found, expected, log_z = quality.chain_marginals(scores, start, move)
    assert np.allclose(found, good / total) and np.allclose(expected, moves / total)
    assert math.isclose(log_z, math.log(total))


def test_op6_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    found = bindings.op6_quality_classifier(spark, SF_DIR).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == _held_out(r.doc_id, 3, 1) for r in found)
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    judged = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) > 0.97


def test_quality_of_edge_rows(spark, edges):
    model = bindings.quality_model(spark, bindings.documents(spark, SF_DIR), SF_DIR)
    found = quality.score_quality(edges, model).collect()
    assert sorted(map(repr, (r.id for r in found))) == sorted(map(repr, (n for n, _ in EDGES)))
    by_id = {r.id: r.score for r in found}
    assert by_id[None] == by_id[1]
    assert quality.keep_good(edges, model, least=0.0).schema == edges.schema
    assert quality.keep_good(edges, model, least=0.0).count() == len(EDGES)
    assert quality.score_quality(edges.limit(0), model).collect() == []


def test_quality_without_labels(spark, edges):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one_kind = spark.createDataFrame([(2, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    for labels, score in ((none, 0.5), (one_kind, 1.0)):
        model = quality.train_quality(edges, labels)
        assert {r.score for r in quality.score_quality(edges, model).collect()} == {score}


def test_forward_sums_equal_all_segmentations():
    known = language.Vocabulary(VOCABULARY)
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(known.size), 2).T)
    words = [b" the", b" information", b" x", "été".encode()]

    def brute(word, column):
        if not word:
            return 1.0
        return sum(
            math.exp(logs[known.piece[word[:n]], column]) * brute(word[n:], column)
            for n in range(1, len(word) + 1) if word[:n] in known.piece
        )

    found = language.word_log_probabilities(known, words, logs)
    assert np.allclose(found, [[math.log(brute(w, c)) for c in (0, 1)] for w in words])
    uses = language.expected_pieces(known, words, np.array([1.0, 2, 1, 1]), np.array([0, 1, 0, 1]), logs)
    covered = sum(len(p) * uses[n].sum() for p, n in known.piece.items())
    assert math.isclose(covered, 4 + 2 * 12 + 2 + 5)  # every byte of every word once


@pytest.mark.parametrize("word", ["ab" * 1000, "é" * 700, "the" * 13, "the" * 14, "日本語" * 400])
def test_long_runs_of_letters_are_summed_whole(word):
    """No cut, whatever the length: against a forward pass over the whole run."""
    known = language.Vocabulary(VOCABULARY)
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(known.size), 3).T)
    raw = b" " + word.encode()
    longest = max(map(len, known.piece))
    ahead = [np.zeros(3)]
    for end in range(1, len(raw) + 1):
        paths = [ahead[n] + logs[known.piece[raw[n:end]]] for n in range(max(0, end - longest), end)
                 if raw[n:end] in known.piece]
        ahead.append(np.logaddexp.reduce(paths, axis=0))
    found = language.word_log_probabilities(known, [b" the", raw, b" a"], logs)
    assert np.allclose(found[1], ahead[-1], rtol=1e-10)
    uses = language.expected_pieces(known, [raw], np.array([2.0]), np.array([1]), logs)
    assert math.isclose(sum(len(p) * uses[n].sum() for p, n in known.piece.items()), 2 * len(raw))


def test_op7_on_held_out_documents(spark):
    spoken = {d.doc_id: d.lang for d in bindings.documents(spark, SF_DIR).collect()}
    found = bindings.op7_language_id(spark, SF_DIR).collect()
    assert len(found) == len(spoken) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == _held_out(r.doc_id, 5, 0) for r in found)
    right = [r.lang_pred == spoken[r.doc_id] for r in found if r.held_out]
    assert np.mean(right) > 0.98


def test_language_of_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "en", "the cat and the dog"), (2, "de", "der Hund und die Katze"), (3, None, "le la"),
         (4, "en", None), (None, "en", ""), (5, "xx", "12 !"), (5, "xx", "12 !"), (6, "en", "a" * 900)],
        "doc_id bigint, lang string, text string",
    ).selectExpr("*", "1 AS word", "2 AS n", "3 AS id")
    model = language.train_language(docs, VOCABULARY)
    assert model.languages == ["de", "en"]
    found = {r.id: (r.lang_pred, r.score) for r in language.identify_language(docs, model).collect()}
    assert found[1][0] == "en" and found[2][0] == "de"
    assert all(found[n] == ("und", 0.0) for n in (4, None, 5))
    assert language.identify_language(docs, model).count() == 8
    nothing = language.train_language(docs.limit(0), VOCABULARY)
    assert nothing.languages == []
    assert {r.lang_pred for r in language.identify_language(docs, nothing).collect()} == {"und"}


def test_op4_counts_and_scores(spark):
    texts = {d.doc_id: d.text.encode().lower().split() + [b""]
             for d in bindings.documents(spark, SF_DIR).collect()}
    counts = collections.Counter()
    for number, tokens in texts.items():
        if not _held_out(number, 10, 0):
            counts.update(tokens)
    total = sum(counts.values())
    floor = math.log10(total + 0.1 * (len(counts) + 1))
    found = bindings.op4_lm_scoring(spark, SF_DIR).collect()
    assert len(found) == len(texts)
    for r in found:
        tokens = texts[r.doc_id]
        assert r.held_out == _held_out(r.doc_id, 10, 0)
        assert (r.n_tokens, r.train_tokens) == (len(tokens), total)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        base = sum(math.log10(counts[t] + 0.1) - floor for t in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_token_probabilities_add_up():
    """Over all strings of up to two bytes of a tiny alphabet and one escape for the rest."""
    tokens, uses = [b"a", b"ab", b"b", b""], np.array([5, 3, 2, 4])
    table = scoring.count_bits(tokens, uses)
    mixer = scoring.Mixer()
    mixer.learn(tokens, uses, table)
    alphabet = [bytes([n]) for n in range(256) if n != 0x20]
    ends = mixer.log10([b"", *alphabet], *scoring.slot_odds(table))
    # P(end) + sum over first bytes of P(byte, end) is less than 1; longer tokens have the rest.
    assert 0 < (10**ends).sum() < 1
    assert (10**ends).sum() > 0.5
    assert mixer.log10([b"a"], *scoring.slot_odds(table))[0] > mixer.log10([b"z"], *scoring.slot_odds(table))[0]


def test_adapting_equals_the_running_product():
    spoken = np.array([[0.5, 0.1], [0.3, 0.2], [0.2, 0.7]])
    sequence = [0, 1, 1, 2, 1, 0, 0, 0]
    total = 0.0
    for kind, pace in itertools.product((0, 1), scoring.PACES):
        product, seen = 1.0, [0, 0, 0]
        for t, token in enumerate(sequence):
            product *= (seen[token] + pace * spoken[token, kind]) / (t + pace)
            seen[token] += 1
        total += product / (2 * len(scoring.PACES))
    found = scoring.adapted(np.log10(spoken), np.array([4.0, 3, 1]), np.zeros(3, int), 1)
    assert math.isclose(found[0], math.log10(total), rel_tol=1e-9)


@pytest.mark.parametrize("held", [True, False])
def test_scores_of_edge_rows(spark, edges, held):
    found = scoring.score_texts(edges, F.lit(held)).collect()
    assert sorted((r.id is None, r.id or 0, r.n_tokens) for r in found) == [
        (False, 1, 1), (False, 2, 4), (False, 2, 4), (False, 3, 2), (False, 4, 1), (True, 0, 1)
    ]
    assert {r.train_tokens for r in found} == {0 if held else 13}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert scoring.score_texts(edges.limit(0), F.lit(held)).collect() == []


def test_following_equals_the_running_product():
    spoken = np.array([[0.5, 0.1], [0.3, 0.2], [0.2, 0.7]])
    documents = [[0, 1, 1, 2, 1, 0, 0, 2], [1, 2]]
    sequence, owner = np.array(sum(documents, [])), np.repeat([0, 1], [8, 2])
    uses, counts = np.array([9, 4, 0]), np.array([[2, 3, 4], [1, 0, 3], [0, 0, 0]])
    pairs, which = scoring.pairs_in(sequence, 3)
    before, token = np.divmod(pairs, 3)
    found = scoring.followed(
        np.log10(spoken), sequence, owner, 2, counts[before, token][which], uses[before][which]
    )
    for number, document in enumerate(documents):
        total = []
        for kind, pace, strength in itertools.product((0, 1), scoring.FOLLOWED, scoring.STRENGTHS):
            product, seen, last = 1.0, [0, 0, 0], 2
            for t, token in enumerate(document):
                e = (seen[token] + pace * spoken[token, kind]) / (t + pace)
                s = strength * math.sqrt(1 + uses[last])
                product *= (counts[last, token] + s * e) / (uses[last] + s)
                seen[token] += 1
                last = token
            total.append(product)
        assert math.isclose(found[number], math.log10(np.mean(total)), rel_tol=1e-9)


def test_word_order_counts(spark):
    """Shuffled words had the score of the text; pairs are counted over all rows and tasks."""
    words = [f"w{n}" for n in range(20)]
    rows = [(n, " ".join(words[n % 20:] + words[: n % 20])) for n in range(1, 60)]
    shuffled = np.random.default_rng(0).permutation(words).tolist()
    rows += [(1000, " ".join(words)), (1001, " ".join(shuffled))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.id: r for r in scoring.score_texts(docs, F.col("doc_id") >= 1000).collect()}
    assert found[1000].base_score == found[1001].base_score
    assert found[1000].score > found[1001].score + 5


@pytest.mark.parametrize("at_once", [1, 7, 1 << 21])
def test_pairs_are_counted_over_all_training_texts(spark, monkeypatch, at_once):
    monkeypatch.setattr(scoring, "_PAIRS_AT_ONCE", at_once)
    texts = {1: "a b a b", 2: "b a", 3: "a b c", 4: "", 5: "c a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = scoring._token_rows(docs, "doc_id", "text", F.col("doc_id") == 5)
    rows = written(rows, "rows")
    wanted = collections.Counter()
    for number, text in texts.items():
        said = ["", *text.split(), ""]
        if number != 5:
            wanted.update(zip(said, said[1:]))
    answers = {r.batch: r.answers for r in scoring._pair_counts(rows).collect()}
    seen = set()
    for r in rows.collect():
        tokens = [bytes(t).decode() for t in r.tokens]
        sequence = scoring.unpacked_planes(bytes(r.sequence), "<u4").astype(int)
        pairs, _ = scoring.pairs_in(sequence, len(tokens))
        _, order = scoring.pair_hashes([bytes(t) for t in r.tokens], pairs)
        counts = np.concatenate([
            scoring.unpacked_planes(bytes(a.counts), "<i8") for a in answers[r.batch]])
        assert counts.size == pairs.size
        for pair, n in zip(pairs[order], counts):
            named = tokens[pair // len(tokens)], tokens[pair % len(tokens)]
            assert n == wanted[named]
            seen.add(named)
    assert seen >= set(wanted)


def test_mixing_weights_learn_from_all_tokens(spark, monkeypatch):
    """Above 400,000 different tokens, only a class of a hash was learned from."""
    docs = spark.range(410).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(1, 1000), n -> id * 1000 + n), ' ') AS text"
    )
    sizes = []

    def learned(counted, table):
        sizes.extend(r["n"] for r in counted.groupBy(F.spark_partition_id()).agg(
            F.count_if(F.col("uses") > 0).alias("n")).collect())
        return scoring.Mixer()

    monkeypatch.setattr(scoring, "_gathered_bits", lambda _: scoring.BitCounts({}))
    monkeypatch.setattr(scoring, "_learned_mixer", learned)
    scoring.score_texts(docs, F.lit(False))
    assert sum(sizes) == 410_001
    assert min(sizes) > 150_000


def test_bit_counts_grow_by_ones():
    """Floats of 32 bits stop at 16.7 million."""
    tokens, uses = [b"a", b"ab", b""], np.array([1 << 24, 1, 3])
    table = scoring.count_bits(tokens, uses)
    assert table[: 1 << scoring.SLOTS[0]].sum() == 8 * (2 * (1 << 24) + 3 * 1 + 1 * 3)


def _by_hand(token, counts, mixer, learned_from=None):
    """A token's probability and its bits' errors, one bit at a time, contexts as plain keys."""
    spelled = b" " + token + b" "
    found = 1.0
    for at in range(1, len(spelled)):
        past = spelled[:at]
        contexts = [min(at, 8), *[past[-n:] if n <= at else past for n in range(1, 5)], past]
        node = 1
        for bit in range(7, -1, -1):
            value = spelled[at] >> bit & 1
            cells = [counts.get((order, c, node), (0, 0)) for order, c in enumerate(contexts)]
            trust = [min(math.frexp(a + b)[1], 8) for a, b in cells]
            longest = max((n + 1 for n, t in enumerate(trust) if t), default=0)
            gate = (longest * 9 + trust[max(longest - 1, 0)]) * 8 + bit
            dot = sum(w * (math.log(b + 0.4) - math.log(a + 0.4)) for w, (a, b) in
                      zip(mixer.weights[gate], cells))
            p = min(max(1 / (1 + math.exp(-dot)), 1e-7), 1 - 1e-7)
            place = (min(max(math.log(p / (1 - p)), -8), 8) / 8 + 1) * 16
            low = min(int(place), 31)
            seen = mixer.outcomes[gate, :, 1] / mixer.outcomes[gate].sum(axis=1)
            refined = (p + (1 - place + low) * seen[low] + (place - low) * seen[low + 1]) / 2
            found *= refined if value else 1 - refined
            node = 2 * node + value
    return found


def test_mixing_equals_a_plain_walk_bit_by_bit():
    """Hashed contexts, gates, mixing and refinement against dictionaries; tokens of any length."""
    tokens = [b"the", b"then", b"there", b"a", b"", "é".encode(), b"ab" * 40, b"x" * 70, b"x" * 200 + b"y"]
    uses = np.array([9, 2, 3, 7, 20, 1, 2, 1, 1])
    counts = {}
    for token, n in zip(tokens, uses.tolist()):
        spelled = b" " + token + b" "
        for at in range(1, len(spelled)):
            past, node = spelled[:at], 1
            contexts = [min(at, 8), *[past[-k:] if k <= at else past for k in range(1, 5)], past]
            for bit in range(7, -1, -1):
                value = spelled[at] >> bit & 1
                for order, context in enumerate(contexts):
                    cell = list(counts.get((order, context, node), (0, 0)))
                    cell[value] += n
                    counts[order, context, node] = tuple(cell)
                node = 2 * node + value
    table = scoring.count_bits(tokens, uses)
    mixer = scoring.Mixer()
    mixer.learn(tokens, uses, table)
    asked = [*tokens, b"thee", b"zz", b"x" * 199]
    found = mixer.log10(asked, *scoring.slot_odds(table))
    for token, value in zip(asked, found):
        assert math.isclose(value, math.log10(_by_hand(token, counts, mixer)), rel_tol=1e-4), token


def test_every_use_is_learned_from_the_others():
    table = np.array([[0, 0], [1, 0], [0, 3], [5, 2]])
    odds, trust = scoring.others_odds(table)
    assert odds[1, 0] == 0 and math.isclose(odds[2, 1], math.log(2.4) - math.log(0.4), rel_tol=1e-6)
    assert math.isclose(odds[3, 0], math.log(2.4) - math.log(4.4), rel_tol=1e-6)
    assert trust.tolist() == [0, 0, 2, 3]


def test_packed_counts_are_the_counts(spark):
    counted = spark.createDataFrame([(b"the", 5), (b"a", 0), (b"x" * 100, 1)], "token binary, uses bigint")
    bits = scoring._gathered_bits(counted)
    assert np.array_equal(bits.table(), scoring.count_bits([b"the", b"x" * 100], np.array([5, 1])))
    assert sum(map(len, bits.segments.values())) < 1 << 20
    assert not scoring._gathered_bits(counted.limit(0)).table().any()


def test_long_documents_are_learned_from(spark):
    """Documents beyond most_lines give a stretch of lines, so a label of long ones only counts."""
    good = "\n".join(["The quiet river runs past the old mill and the green fields."] * 900)
    bad = "\n".join(["### $$$ %%% &&& *** click"] * 40)
    docs = [(n, good if n % 2 else bad) for n in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, n % 2) for n, _ in docs], "doc_id bigint, quality int")
    model = quality.train_quality(frame, labels, most_lines=50)
    scores = {r.id: r.score for r in quality.score_quality(frame, model).collect()}
    assert all((scores[n] >= 0.5) == bool(n % 2) for n in scores)


def test_bit_counts_of_a_task_are_narrow_and_grow_on(spark, monkeypatch):
    """A task held two tables of 94 MB; counts past 32 bits go on in 64."""
    rows = [(b"the", 5), (b"a", (1 << 33) + 1), (b"then", 7), (b"b", (1 << 31) + 3)]
    counted = spark.createDataFrame(rows, "token binary, uses bigint").coalesce(1)
    wanted = scoring.count_bits([t for t, _ in rows], np.array([n for _, n in rows]))
    assert np.array_equal(scoring._gathered_bits(counted).table(), wanted)
    monkeypatch.setattr(scoring, "gathered", lambda batches, *_: (
        b.slice(n, 1) for b in batches for n in range(b.num_rows)))
    assert np.array_equal(scoring._gathered_bits(counted).table(), wanted)
    bits = scoring._gathered_bits(counted)
    for found, whole in zip(bits.slot_odds() + bits.others_odds(),
                            scoring.slot_odds(wanted) + scoring.others_odds(wanted)):
        assert np.array_equal(found, whole)


def test_documents_scored_some_at_a_time(spark, monkeypatch):
    """All documents of a row were scored at once; their scores don't depend on it."""
    docs = spark.createDataFrame(
        [(n, " ".join(f"w{(n * k) % 7}" for k in range(n))) for n in range(40)],
        "doc_id bigint, text string").coalesce(1)
    whole = {r["id"]: r for r in scoring.score_texts(docs, F.col("doc_id") % 5 == 0).collect()}
    monkeypatch.setattr(scoring, "_SCORED_AT_ONCE", 16)
    monkeypatch.setattr(scoring, "_ANSWERS_AT_ONCE", 3)
    parts = {r["id"]: r for r in scoring.score_texts(docs, F.col("doc_id") % 5 == 0).collect()}
    assert parts.keys() == whole.keys() == set(range(40))
    for n, r in whole.items():
        assert parts[n][:5] == r[:5] and math.isclose(parts[n].score, r.score, rel_tol=1e-9)
        assert math.isclose(parts[n].base_score, r.base_score, rel_tol=1e-9)
        assert r.n_tokens == n + 1 and parts[n].n_bytes == r.n_bytes


def test_packed_answers_come_back_in_place(spark, monkeypatch):
    monkeypatch.setattr(scoring, "_ANSWERS_AT_ONCE", 50)
    rng = np.random.default_rng(4)
    rows = [(b, p, b * 100 + p, -p / 7 - b, int(rng.integers(-(1 << 62), 1 << 62)), p % 9)
            for b in range(3) for p in range(80 + b)]
    frame = spark.createDataFrame(
        [rows[n] for n in rng.permutation(len(rows))],
        "batch bigint, place int, uses bigint, score double, tilts bigint, size int").repartition(4)
    found = collections.defaultdict(list)
    for r in scoring._packed_answers(frame).collect():
        found[r.batch].append(bytes(r["cells"]))
    back = [(b, *map(lambda v: v.item(), cell)) for b in sorted(found)
            for cell in scoring._unpacked_answers(found[b])]
    assert back == rows


def test_adapting_to_many_uses():
    """Short products of frequent tokens and long ones are the same running product."""
    times = np.array([40.0, 1, 2, 12, 13, 11, 3])
    scores = np.log10(np.array([[0.3, 0.1, 0.2, 0.1, 0.05, 0.05, 0.01]])).T
    total = 0.0
    for pace in scoring.PACES:
        product, place = 1.0, 0
        for n, p in zip(times.astype(int), 10 ** scores[:, 0]):
            for k in range(n):
                product *= (k + pace * p) / (place + pace)
                place += 1
        total += product / len(scoring.PACES)
    found = scoring.adapted(scores, times, np.zeros(7, int), 1)
    assert math.isclose(found[0], math.log10(total), rel_tol=1e-9)


@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_tokens_are_counted_in_packed_blocks(spark, monkeypatch, at_once):
    """Every token of every row was a row of two shuffles, spelled out; now a row per block is."""
    monkeypatch.setattr(scoring, "_TOKENS_AT_ONCE", at_once)
    texts = {1: "a b a b", 2: "b a", 3: "a b c", 4: "", 5: "c a b d", 6: "e" * 3000 + " é f"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = written(scoring._token_rows(docs, "doc_id", "text", F.col("doc_id") == 5), "rows")
    wanted = collections.Counter()
    for number, text in texts.items():
        wanted.update({t: int(number != 5) * n for t, n in collections.Counter([*text.split(), ""]).items()})
    buckets = written(scoring._token_counts(rows), "counts")
    vocabulary = buckets.filter("sizes IS NOT NULL")
    found = scoring._counted_tokens(vocabulary).collect()
    assert len(found) == len(wanted) == 8
    assert {bytes(r.token).decode(): r.uses for r in found} == dict(wanted)
    assert all(sum(r[f"kind_{n}"] for n in range(scoring.KINDS)) == r.uses for r in found)
    spoken = {r.bucket: scoring.unpacked_tokens(r.sizes, r.spelled).to_pylist() for r in vocabulary.collect()}
    assert len(spoken) == 1 if at_once > 3 else len(spoken) > 1
    own, seen = {r.batch: [bytes(t) for t in r.tokens] for r in rows.collect()}, collections.Counter()
    for r in buckets.filter("sizes IS NULL").collect():
        places = np.cumsum(scoring.unpacked_planes(bytes(r.places), "<u4"), dtype=np.uint32)
        which = np.cumsum(scoring.unpacked_planes(bytes(r.which), "<u4"), dtype=np.uint32)
        assert [own[r.batch][p] for p in places] == [spoken[r.bucket][w] for w in which]
        seen.update((r.batch, p) for p in places.tolist())
    assert set(seen.values()) == {1} and len(seen) == sum(map(len, own.values()))


def test_no_shuffle_by_single_tokens(spark):
    """The answers came by a join of a row for every token of every row."""
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id bigint, text string")
    plan = scoring.score_texts(docs, F.lit(False))._jdf.queryExecution().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(token" not in plan


def test_following_through_very_unlikely_tokens():
    """Products of positions don't run out of a double's range; position by position they can't."""
    rng = np.random.default_rng(5)
    for least in (-3.0, -40.0, -280.0):
        scores = rng.uniform(least, -0.5, (60, 2))
        sequence, owner = rng.integers(0, 60, 400), np.repeat([0, 1, 2], [250, 1, 149])
        together = rng.integers(0, 2, 400) * rng.integers(0, 4, 400)
        before = together + rng.integers(0, 3, 400)
        found = scoring.followed(scores, sequence, owner, 3, together, before)
        for number in range(3):
            at, total = np.flatnonzero(owner == number), []
            for kind, pace, strength in itertools.product((0, 1), scoring.FOLLOWED, scoring.STRENGTHS):
                told, uses = 0.0, collections.Counter()
                for t, n in enumerate(at):
                    e = (uses[sequence[n]] + pace * 10 ** scores[sequence[n], kind]) / (t + pace)
                    s = strength * math.sqrt(1 + before[n])
                    told += math.log((together[n] + s * e) / (before[n] + s))
                    uses[sequence[n]] += 1
                total.append(told)
            wanted = (np.logaddexp.reduce(total) - math.log(len(total))) / math.log(10)
            assert math.isclose(found[number], wanted, rel_tol=1e-9)


def test_positions_take_little_beside_their_hashes():
    """Hashing took 40 bytes a position on the way, and numbering them 50 more, in every worker."""
    tokens = [b"%d" % n for n in range(1000)] + [b""]
    sequence = np.random.default_rng(6).integers(0, len(tokens), 1 << 20).astype(np.uint32)
    own = scoring.token_hashes(tokens)
    wanted = own[scoring.tokens_before(sequence, len(tokens))] * scoring._M1 + own[sequence]
    tracemalloc.start()
    try:
        hashes = scoring.pairs_hashed(tokens, sequence)
        assert tracemalloc.get_traced_memory()[1] < 16 * sequence.size
        assert np.array_equal(hashes, wanted)
        different, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        number = scoring.numbered(hashes)
        assert tracemalloc.get_traced_memory()[1] - held < 24 * sequence.size
    finally:
        tracemalloc.stop()
    assert np.array_equal(number, which)
    found, n = scoring.counted_in_order(hashes)
    assert np.array_equal(found, different) and np.array_equal(n, times)
    nothing = np.empty(0, np.uint64)
    assert scoring.numbered(nothing).size == scoring.counted_in_order(nothing)[0].size == 0


def test_rows_go_through_the_jvm_packed(spark):
    """Rows held an array with an object for each of their tokens, and were packed by a pass of its own."""
    docs = spark.createDataFrame(
        [(1, "a b a"), (2, None), (3, "é a\x00 " + "x" * 300)], "doc_id bigint, text string").coalesce(1)
    plan = scoring.score_texts(docs, F.lit(False))._jdf.queryExecution().toString()
    assert "spelled#" in plan and not re.search(r"\btokens#", plan)
    opened, packed = (
        scoring._token_rows(docs, "doc_id", "text", F.col("doc_id") == 1, packed=p).collect()[0]
        for p in (False, True))
    tokens = scoring.unpacked_tokens(bytes(packed.sizes), bytes(packed.spelled)).to_pylist()
    assert tokens == [bytes(t) for t in opened.tokens] == [b"a", b"a\x00", b"b", b"x" * 300, "é".encode(), b""]
    assert all(packed[c] == opened[c] for c in ("uses", "ids", "n_tokens", "sequence", "n_pairs", "n_different"))
