"""Personal data: generators propose spans, boosted trees judge them, thresholds select.

Spans that meet a fixed format and its check (email, ip, card, phone) are always found.
Beyond them, generators of high recall propose spans that may overlap: disguised
addresses, dotted and colon-separated numbers, and digits with separators, whole and in
parts. Boosted trees score them by the form of the span and by what stands around it.

There are no labels for that, so the fixed formats teach it: what meets one is an example,
what looks alike and fails its check is a counterexample, and both are also rewritten in
place into forms that the fixed formats don't know (a phone without its country code, an
address spelled "name at host dot org"; a date, a version, a number with a wrong digit).
Candidates whose form can't be checked are neither. All examples fit the trees: Spark adds
their gradients up by value, so only such sums reach the driver. Trees fitted without a
fourth of the examples score that fourth, and these scores of all examples set, for each
generator, the least score at which the wanted precision still holds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import by_size, gathered, id_and_text, ship_package, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "host", "number")
KINDS = BASE + ADDED
EMAIL, IP, CARD, PHONE, ADDRESS, HOST, NUMBER = range(7)
Span = tuple[int, int, int]

# Possessive repeats and lookbehinds keep matching linear in long runs of one class; they
# find what the plain patterns find.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_AT = re.compile(r" ?(?:\(at\)|\[at\]) ?| at |@", re.IGNORECASE)
_SPELLED = re.compile(
    r"[A-Za-z0-9-]+(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z0-9-]+)+", re.IGNORECASE
)
_DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+")
_COLONS = re.compile(
    r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Fa-f:])"
)
_NUMBER = re.compile(r"(?:\+|\()?(?<![0-9])[0-9](?:[ ().\/-]{0,2}[0-9])++")

#: Words that often stand before personal data, in the languages of the corpus.
CUES = (
    "address", "call", "card", "contact", "email", "fax", "mail", "mobile", "phone", "tel",
    "telefon", "telefono", "teléfono", "téléphone", "correo", "courriel", "karte", "tarjeta",
    "carte", "kontakt", "ip", "host", "number", "nummer", "número", "numéro",
)
_CUES = re.compile(r"\b(?:" + "|".join(CUES) + r")\b", re.IGNORECASE)
_AROUND = 40

#: Parts of the examples; each is scored by trees that have not seen it.
FOLDS = 4
#: Different examples that are fitted on the driver, about 5 MB, or by one task of a larger fit.
_ROWS_AT_ONCE = 100_000
#: Trees until a larger fit writes the examples' log odds anew.
_TREES_AT_ONCE = 5
#: Gradients are whole numbers of this part, so their sums don't depend on an order.
_PART = 1 << 24
#: Scores are told apart in so many steps where thresholds are set.
_SCORE_STEPS = 1 << 16


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(spans that meet a format, matches that failed its check): (start, kind, end)."""
    met: list[Span] = []
    failed: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        # Every address has one @, so matches can be looked for around each of them.
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            met.append((start, EMAIL, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        fits = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
        (met if fits else failed).append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        fits = 14 <= len(digits) <= 19 and passes_luhn(digits)
        (met if fits else failed).append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            fits = 10 <= len(_digits(m[0])) <= 15
            (met if fits else failed).append((m.start(), PHONE, m.end()))
    return sorted(met), failed


def proposed_spans(text: str) -> list[Span]:
    """Candidates of the generators, overlapping ones included: (start, kind, end)."""
    found = set()
    if "@" in text or "at" in text or "AT" in text or "At" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start and text[start - 1] in _LOCAL:
                start -= 1
            domain = _SPELLED.match(text, m.end()) if start < m.start() else None
            # Plain words around "at" say nothing: something must be spelled out or cut off.
            if domain and (m[0].strip(" ").lower() != "at" or "dot" in domain[0].lower()
                           or "." in text[start : m.start()] + domain[0]):
                found.add((start, ADDRESS, domain.end()))
    for m in _DOTTED.finditer(text):
        found.add((m.start(), HOST, m.end()))
    if ":" in text:
        for m in _COLONS.finditer(text):
            found.add((m.start(), HOST, m.end()))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        spans = [(m.start(), m.end())]
        if " " in m[0]:
            spans += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^ ]+", m[0])]
            first = m[0].find(" ")
            spans.append((m.start() + first + 1, m.end()))
        for start, end in spans:
            if sum("0" <= c <= "9" for c in text[start:end]) >= 7:
                found.add((start, NUMBER, end))
    return sorted(found)


def features(text: str, span: Span, near: int) -> list[int]:
    """Small integers about the form of a candidate and what stands around it."""
    start, kind, end = span
    s = text[start:end]
    before, after = text[max(start - _AROUND, 0) : start], text[end : end + _AROUND]
    digits = _digits(s)
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    letters = sum(c.isalpha() for c in s)
    seps = [c for c in s if not c.isalnum()]
    ip = kind == HOST and "." in s and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    cue = -1
    for m in _CUES.finditer(before):
        cue = len(before) - m.end()
    lead, follow = before[-1:], after[:1]
    return [
        kind, len(s), len(digits), letters, len(seps), len(groups), max(sizes), min(sizes),
        sizes[0], sizes[-1], s.count("."), s.count("-"), s.count(" "), s.count("("),
        s.count(":"), s.count("/"), s.startswith("+"), s.startswith("("), "@" in s,
        "at" in s.lower() and "@" not in s, "dot" in s.lower(), "[" in s or "(at" in s.lower(),
        len(digits) >= 13 and passes_luhn(digits), ip, len(set(digits)),
        len(s.rpartition(".")[2]) if "." in s else 0, len(set(seps)),
        lead.isalnum() * 2 + (lead != "" and not lead.isspace()),
        follow.isalnum() * 2 + (follow != "" and not follow.isspace()),
        min(cue + 1, 41), sum(c.isdigit() for c in before + after), near,
        before.rstrip().endswith((":", "=")),
    ]


WIDTH = len(features("0", (0, NUMBER, 1), 0))


def _overlaps(start: int, end: int, spans: list[Span]) -> bool:
    """Whether one of the spans (ascending) shares a character with start..end."""
    return any(s < end and start < e for s, _, e in spans)


def candidates(text: str) -> tuple[list[Span], list[Span], list[Span], np.ndarray]:
    """(base spans, failed matches, proposed spans, their features)."""
    base, failed = base_spans(text)
    spans = proposed_spans(text)
    starts = [s for s, _, _ in spans]
    rows = []
    for span in spans:
        near = bisect_left(starts, span[0] + 80) - bisect_left(starts, span[0] - 80) - 1
        rows.append(features(text, span, near))
    made = np.clip(np.array(rows, np.int64), 0, 255).astype(np.uint8)
    return base, failed, spans, made


def _rewritten(text: str, span: Span) -> Iterator[tuple[int, str]]:
    """(label, other form) for a base span; forms the fixed formats don't know."""
    start, kind, end = span
    s = text[start:end]
    digits = _digits(s)
    if kind == EMAIL:
        local, host = s.split("@")
        yield 1, f"{local} at {host.replace('.', ' dot ')}"
        yield 1, f"{local}(at){host}"
        yield 1, f"{local} [at] {host.replace('.', ' [dot] ')}"
        words = re.findall("[a-z]{2,}", text[max(start - 200, 0) : end + 200]) or ["it"]
        a, b, c = words[0], words[len(words) // 2], words[-1]
        yield 0, f"{a} at {b}.{c}"
        yield 0, f"{a} at {b} dot {c}"
        yield 0, f"{a}@{b}"
    elif kind == PHONE:
        code, _, rest = s.partition(" ")
        plain = digits[-10:]
        yield 1, rest if rest and len(_digits(rest)) >= 7 else plain[:3] + "-" + plain[3:6] + "-" + plain[6:]
        yield 1, f"({plain[:3]}) {plain[3:6]}-{plain[6:]}"
        yield 1, f"{plain[:3]}.{plain[3:6]}.{plain[6:]}"
        yield 1, f"{plain[:3]} {plain[3:6]} {plain[6:]}"
        yield 0, plain
        yield 0, f"{1900 + int(plain[:2])}-{plain[2:4]}-{plain[4:6]}"
        yield 0, f"{plain[:4]}/{plain[4:6]}/{plain[6:8]}"
        yield 0, f"{plain[:7]}.{plain[7:9]}"
        yield 0, f"{plain[:4]}-{plain[4:8]}"
        yield 0, f"{plain[:3]}.{plain[3:5]}.{plain[5:]}.{plain[5]}"
    elif kind == CARD:
        yield 0, digits[:-1] + str((int(digits[-1]) + 1) % 10)
        yield 0, digits[:13] if not passes_luhn(digits[:13]) else digits[:12]
    elif kind == IP:
        parts = s.split(".")
        yield 0, ".".join([*parts, parts[0]])
        yield 0, ".".join(parts[:3])
        yield 0, ".".join([parts[0], str(int(parts[1]) + 300), *parts[2:]])
        groups = [f"{int(p):x}{n}" for n, p in enumerate(parts)]
        yield 1, ":".join([*groups, *groups])
        yield 1, "fe80::" + ":".join(groups)
        yield 0, ":".join(f"{int(p) % 60:02d}" for p in parts)


def examples(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(label, features) of the candidates of a text that the fixed formats can judge."""
    base, failed, spans, rows = candidates(text)
    wrong = sorted(failed)
    for (start, kind, end), row in zip(spans, rows):
        own = [b for b in base if (b[1] == IP) == (kind == HOST)] if kind != ADDRESS else base
        if _overlaps(start, end, own):
            yield 1, row
        elif _overlaps(start, end, base):
            continue  # digits of another kind's span are no number, yet no counterexample
        elif kind != ADDRESS and _overlaps(start, end, wrong):
            # A phone or an id in other writing can't be told by the fixed formats.
            digits = sum("0" <= c <= "9" for c in text[start:end])
            if kind == HOST or digits > 12 or text[start:end].isdigit():
                yield 0, row
    for span in base:
        start, _, end = span
        before, after = text[max(start - 200, 0) : start], text[end : end + 200]
        for label, form in _rewritten(text, span):
            window = f"{before}{form}{after}"
            a, b = len(before), len(before) + len(form)
            _, _, again, made = candidates(window)
            for (s, _, e), row in zip(again, made):
                if (label and (s, e) == (a, b)) or (not label and s < b and a < e):
                    yield label, row


@dataclass
class Trees:
    """Boosted trees of one depth over features of a byte each; leaves add to log odds."""

    start: float
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def grown(self, x: np.ndarray, total: np.ndarray, since: int = 0) -> np.ndarray:
        """``total`` with what the trees from the ``since``-th on add to it, one by one."""
        rows = np.arange(len(x))
        for (feature, cut), leaf in zip(self.splits[since:], self.leaves[since:]):
            node = np.zeros(len(x), np.int64)
            # Nodes are numbered level by level; leaves come after the inner ones.
            while len(x) and node[0] < feature.size:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total = total + leaf[node - feature.size]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.grown(x, np.full(len(x), self.start))))


Level = tuple[np.ndarray, np.ndarray]


@dataclass
class Examples:
    """Different examples as arrays; ``odds`` has a column for each model that is fitted.

    A model leaves the fold of its number out.
    """

    x: np.ndarray
    label: np.ndarray
    times: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    odds: np.ndarray

    def sums(self, growing: list[list[Level]]) -> np.ndarray:
        """(models, 2, features, nodes * 256): slopes and curves by value, in each node that
        the next level of a model's tree splits."""
        nodes = 1 << len(growing[0])
        found = np.zeros((len(growing), 2, self.x.shape[1], nodes * 256))
        for model, levels in enumerate(growing):
            seen = np.flatnonzero(self.fold != model)
            x, weight = self.x[seen], self.weight[seen] * _PART
            p = 1 / (1 + np.exp(-self.odds[seen, model]))
            slope, curve = np.rint((self.label[seen] - p) * weight), np.rint(p * (1 - p) * weight)
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for feature, cut in levels:
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            node *= 256
            for f, values in enumerate(np.ascontiguousarray(x.T)):
                cell = node + values
                found[model, 0, f] = np.bincount(cell, slope, nodes * 256)
                found[model, 1, f] = np.bincount(cell, curve, nodes * 256)
        return found

    def add(self, models: list[Trees], since: int) -> None:
        """Take the models' trees from the ``since``-th on into the log odds."""
        for n, model in enumerate(models):
            self.odds[:, n] = model.grown(self.x, self.odds[:, n], since)

    def unseen(self) -> np.ndarray:
        """Each example's score from the model that left it out, in whole steps."""
        odds = self.odds[np.arange(len(self.fold)), self.fold]
        return np.floor(_SCORE_STEPS / (1 + np.exp(-odds))).astype(np.int64)

    def unseen_counts(self) -> Iterator[tuple[np.ndarray, ...]]:
        yield self.x[:, 0], self.unseen(), self.label, self.times


class SpreadExamples:
    """Examples as a table: every step is a job over all of them, in parts.

    Parts get the trees and return sums by value, so what a task and the driver hold is
    bounded by the trees' features, not by the number of examples.
    """

    def __init__(self, found: DataFrame, starts: list[float], rows: int):
        self.parts = 1 + rows // _ROWS_AT_ONCE
        self.frame = found.withColumn("odds", F.array(*map(F.lit, starts)))
        self.models: list[Trees] = []
        self.since = 0

    def _held(self):
        """What makes the arrays of a part, with the trees that its log odds don't have yet."""
        models, since = self.models, self.since

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Examples]]:
            for batch in gathered(batches, "row", 1 << 22):
                held = example_arrays(batch)
                held.add(models, since)
                yield batch, held

        return parts

    def sums(self, growing: list[list[Level]]) -> np.ndarray:
        parts = self._held()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, held in parts(batches):
                more = held.sums(growing)
                total = more if total is None else np.add(total, more, out=total)
            if total is not None:
                slope, curve = (total[:, n].astype(np.int64).ravel() for n in (0, 1))
                cell = np.flatnonzero((slope != 0) | (curve != 0))
                made = pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(slope[cell]), pa.array(curve[cell])],
                    ["cell", "slope", "curve"],
                )
                yield from (made.slice(a, 20_000) for a in range(0, made.num_rows, 20_000))

        found = (
            self.frame.coalesce(self.parts).mapInArrow(add, "cell bigint, slope bigint, curve bigint")
            .groupBy("cell").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve"))
            .coalesce(4).toArrow()
        )
        shape = (len(growing), WIDTH, 256 << len(growing[0]))
        total = np.zeros((2, math.prod(shape)))
        for n, name in enumerate(("slope", "curve")):
            total[n, found.column("cell").to_numpy()] = found.column(name).to_numpy()
        return np.moveaxis(total.reshape(2, *shape), 0, 1)

    def add(self, models: list[Trees], since: int) -> None:
        self.models = models
        if len(models[0].leaves) - self.since < _TREES_AT_ONCE:
            return
        parts = self._held()

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, held in parts(batches):
                at = batch.schema.get_field_index("odds")
                ends = pa.array(np.arange(len(held.odds) + 1, dtype=np.int32) * held.odds.shape[1])
                odds = pa.ListArray.from_arrays(ends, pa.array(held.odds.ravel()))
                yield batch.set_column(at, "odds", odds)

        frame = self.frame.coalesce(self.parts).mapInArrow(update, self.frame.schema)
        self.frame, self.since = written(frame, "odds"), len(models[0].leaves)

    def unseen_counts(self) -> Iterator[tuple[np.ndarray, ...]]:
        parts = self._held()
        schema = "kind bigint, step bigint, label double, times bigint"

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, held in parts(batches):
                columns = held.x[:, 0].astype(np.int64), held.unseen(), held.label, held.times
                made = pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["kind", "step", "label", "times"]
                )
                yield from (made.slice(a, 20_000) for a in range(0, made.num_rows, 20_000))

        # At most a row for each kind, step and label, however many examples there are.
        found = (
            self.frame.coalesce(self.parts).mapInArrow(count, schema)
            .groupBy("kind", "step", "label").agg(F.sum("times").alias("times")).toArrow()
        )
        yield tuple(found.column(name).to_numpy() for name in ("kind", "step", "label", "times"))


def example_arrays(batch: pa.RecordBatch | pa.Table) -> Examples:
    def numbers(name: str, kind: type) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False).astype(kind)

    rows = batch.column("row").to_pylist()
    odds = batch.column("odds")
    odds = (odds.combine_chunks() if isinstance(odds, pa.ChunkedArray) else odds).flatten()
    odds = odds.to_numpy().reshape(len(rows), -1).copy()
    return Examples(
        np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), numbers("label", float),
        numbers("n", np.int64), numbers("weight", float), numbers("fold", np.int64), odds,
    )


def boosted(
    examples: Examples | SpreadExamples, starts: list[float], trees: int = 60, depth: int = 3,
    rate: float = 0.3, smoothing: float = 1.0,
) -> list[Trees]:
    """Gradient boosting on the logistic loss with second-order leaves; no randomness.

    Models that leave out different folds are fitted side by side, on the same passes.
    """
    models = [Trees(start) for start in starts]
    for number in range(trees):
        growing: list[list[Level]] = [[] for _ in models]
        leaves = []
        for level in range(depth):
            nodes = 1 << level
            sums = examples.sums(growing) / _PART
            leaves = []
            for model, (slope, curve) in enumerate(sums):
                # By node, feature and value: all up to a value go to the left.
                g, h = (v.reshape(len(v), nodes, 256).swapaxes(0, 1).cumsum(axis=2)
                        for v in (slope, curve))
                g1, h1 = g[..., -1:], h[..., -1:]
                gain = (g**2 / (h + smoothing) + (g1 - g) ** 2 / (h1 - h + smoothing)
                        - g1**2 / (h1 + smoothing))
                feature, cut = np.divmod(gain.reshape(nodes, -1).argmax(axis=1), 256)
                growing[model].append((feature, cut))
                at = np.arange(nodes), feature, cut
                g, h = (np.column_stack([v[at], v1[:, 0, 0] - v[at]]).ravel()
                        for v, v1 in ((g, g1), (h, h1)))
                leaves.append(rate * g / (h + smoothing))
        for model, levels, leaf in zip(models, growing, leaves):
            model.splits.append(tuple(np.concatenate(part) for part in zip(*levels)))
            model.leaves.append(leaf)
        examples.add(models, number)
    return models


def _start(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return math.log(share / (1 - share))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.3,
    smoothing: float = 1.0,
) -> Trees:
    """Boosted trees on all rows of ``x``, each of the same weight."""
    once, start = np.ones(len(x)), _start(y.mean())
    held = Examples(x, y, once, once, np.full(len(x), -1), np.full((len(x), 1), start))
    return boosted(held, [start], trees, depth, rate, smoothing)[0]


@dataclass
class PiiModel:
    """Trees, or None where there was nothing to learn from, and the thresholds by kind."""

    trees: Trees | None
    thresholds: dict[int, float]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), ascending. Added spans overlap no other one: of those
        that overlap, the one with the higher score stays, of equals the longer, earlier."""
        if self.trees is None:
            base, _ = base_spans(text)
            return base, base
        base, _, spans, rows = candidates(text)
        if not spans:
            return base, base
        chosen = []
        ranked = sorted(
            (-score, start - end, start, kind, end)
            for score, (start, kind, end) in zip(self.trees.scores(rows).tolist(), spans)
            if score >= self.thresholds.get(kind, 2.0)
        )
        for _, _, start, kind, end in ranked:
            if not _overlaps(start, end, base) and not _overlaps(start, end, chosen):
                chosen.append((start, kind, end))
        return base, sorted(base + chosen)


def calibrated_threshold(
    scores: np.ndarray, labels: np.ndarray, times: np.ndarray, precision: float
) -> float:
    """The least score, of at least a half, from which on the share of true ones is at
    least ``precision``, each counted as often as it was seen; 2, which no score reaches, where there is none.

    One false example is added to those seen, so few examples don't pass for certainty.
    """
    order = np.argsort(-scores, kind="stable")
    ranked, hits, seen = scores[order], np.cumsum((labels * times)[order]), np.cumsum(times[order])
    last = np.append(ranked[1:] < ranked[:-1], True)  # equal scores stand or fall together
    good = last & (hits >= precision * (seen + 1))
    return max(float(ranked[np.flatnonzero(good)[-1]]), 0.5) if good.any() else 2.0


def train_pii(
    docs: DataFrame, text_col: str = "text", per_label: int = 4000, precision: float = 0.95
) -> PiiModel:
    """Learn from the candidates in all texts of ``docs`` that the fixed formats can judge.

    They are counted over all texts, and all different ones are fitted. The examples of a
    generator and label weigh as much as ``per_label`` together, or each as one if there
    are fewer, so that no kind is drowned by a more frequent one. Thresholds come from all
    examples too, each scored without its fold and counted as often as it was seen. Where
    one label is missing for all generators nothing is learned, and a generator without
    examples, or without a score that reaches ``precision``, adds nothing. Null texts count
    as empty. Runs jobs: a few up to ``_ROWS_AT_ONCE`` different examples, which are fitted
    on the driver, and beyond that one for each level of each tree.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.coalesce(named_column(text_col), F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches):
            labels, rows = [], []
            for text in part.column("text").to_pylist():
                for label, row in examples(text):
                    labels.append(label)
                    rows.append(row.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array(labels, pa.int32()),
                 pa.array(rows, pa.binary())], ["kind", "label", "row"])

    # Equal candidates are one row with a number, so nothing grows with repeated texts.
    found = (
        source.mapInArrow(find, "kind int, label int, row binary")
        .groupBy("kind", "label", "row").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("fold", F.pmod(F.xxhash64("row"), F.lit(FOLDS)))
    )
    found = written(found, "examples")
    different = {(r["kind"], r["label"], r["fold"]): r["n"] for r in
                 found.groupBy("kind", "label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({label for _, label, _ in different}) < 2:
        return PiiModel(None, {})
    weights = {}
    for kind, label in sorted({key[:2] for key in different}):
        weights[kind, label] = min(1.0, per_label / sum(
            n for key, n in different.items() if key[:2] == (kind, label)))
    weight = F.lit(None).cast("double")
    for (kind, label), value in weights.items():
        weight = F.when((F.col("kind") == kind) & (F.col("label") == label), value).otherwise(weight)
    starts = []
    for left_out in range(FOLDS + 1):  # the last model leaves nothing out
        mass = [sum(n * weights[kind, label] for (kind, label, fold), n in sorted(different.items())
                    if label == wanted and fold != left_out) for wanted in (0, 1)]
        starts.append(_start(mass[1] / max(sum(mass), 1e-9)))
    found = found.select("row", "label", "n", "fold", weight.alias("weight"))
    rows = sum(different.values())
    held = SpreadExamples(found, starts, rows)
    if rows <= _ROWS_AT_ONCE:
        held = example_arrays(held.frame.toArrow())
    trees = boosted(held, starts)[FOLDS]
    thresholds = {}
    for kinds, steps, labels, times in held.unseen_counts():
        for kind in (ADDRESS, HOST, NUMBER):
            own = [v[kinds == kind] for v in (steps / _SCORE_STEPS, labels, times)]
            thresholds[kind] = calibrated_threshold(*own, precision)
    return PiiModel(trees, thresholds)


_SPANS = "array<struct<kind: int, start: int, end: int>>"


def pii_spans(
    docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, base, spans) for every row: what the fixed formats find, and that with what the
    model adds, as (kind, start, end) by start and kind, in code points, end exclusive.

    Whole texts are searched; null and empty texts have no spans. Rows and ids are kept as
    they are; an empty table gives no rows; other columns are not read.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    entry = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": s, "end": e} for s, k, e in spans]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches):
            found = [model.spans(text) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([listed(b) for b, _ in found], entry),
                 pa.array([listed(s) for _, s in found], entry)], ["id", "base", "spans"])

    return source.mapInArrow(find, f"id {kind}, base {_SPANS}, spans {_SPANS}")


def redact_pii(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """The rows with every found span replaced by its kind, as ``[email]``.

    Overlapping spans are replaced as one, named by the first. Null texts stay null; all
    other columns stay as they are.
    """
    ship_package(docs.sparkSession)
    schema = docs.schema

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, text_col):
            at = part.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, model.spans(t)[1])
                     for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(redact, schema)


def redacted(text: str, spans: list[Span]) -> str:
    out, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind]}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def count_kind(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
