"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its own shape and that of the lines around it give a score,
neighbouring labels are tied by transition weights, and forward-backward gives each
line's marginal. A document's quality is the mean marginal, weighted by line length.

Labels exist for documents only. Lines of good documents are good; lines of bad ones are
bad unless a first, independent classifier of lines finds them good. The field is then
fitted to those line labels by gradient steps on its likelihood, on a sample of labelled
documents of a stated size.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import by_size, id_and_text, ship_package

_SHAPE = bytearray(b"a" * 256)
for _chars, _mark in (
    (string.ascii_uppercase, b"A"), (string.digits, b"0"), (string.punctuation, b"."),
    (" \t\n\r\x0b\x0c", b" "),
):
    for _char in _chars.encode():
        _SHAPE[_char] = _mark[0]
_SHAPE = bytes(_SHAPE)
_OWN = 11
_BORDER = 2
_REACH = 30.0


def _line_shape(line: bytes, before: bytes | None) -> tuple[float, ...]:
    shape = line.translate(_SHAPE)
    words = line.lower().split()
    n, size = max(len(words), 1), max(len(line), 1)
    upper, punctuation = shape.count(b"A"), shape.count(b".")
    letters = max(shape.count(b"a") + upper, 1)
    spaced = b" " + shape + b" "
    return (
        math.log1p(len(line)),
        upper / letters,
        shape.count(b"0") / size,
        punctuation / size,
        (n - len(set(words))) / n,
        sum(map(eq, words, words[1:])) / n,
        min(size / n, 60.0) / 10,
        spaced.count(b". ") / n,
        shape.count(b" ") / size,
        spaced.count(b" . ") / n,
        float(line == before),
    )


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and how many lines each text has (at least one)."""
    shapes, sizes, counts = [], [], []
    for text in texts:
        lines = text.encode("utf-8", "surrogatepass").split(b"\n")
        before = None
        for line in lines:
            shapes.append(_line_shape(line, before))
            before = line
        sizes.extend(map(len, lines))
        counts.append(len(lines))
    own = np.array(shapes, float).reshape(-1, _OWN)
    counts_ = np.array(counts, np.int64)
    ends = np.cumsum(counts_)
    has_before, has_after = np.ones(len(own), bool), np.ones(len(own), bool)
    has_before[ends - counts_] = False
    has_after[ends - 1] = False
    previous, following = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    # A missing neighbour looks like the line itself and is flagged.
    previous[~has_before] = own[~has_before]
    following[~has_after] = own[~has_after]
    border = np.column_stack([~has_before, ~has_after]).astype(float)
    return np.hstack([own, previous, following, border]), np.array(sizes, float), counts_


def chain_marginals(
    scores: list[float], start: tuple[float, float], move: tuple[float, float, float, float]
) -> tuple[list[float], list[float], float]:
    """P(line is good), expected moves (bad-bad, bad-good, good-bad, good-good), log Z.

    ``scores`` are log odds of good; ``start`` and ``move`` are exponentials of weights.
    """
    bb, bg, gb, gg = move
    forward, scale, odds = [], 0.0, []
    b, g = start
    for at, score in enumerate(scores):
        weight = math.exp(max(-_REACH, min(_REACH, score)))
        odds.append(weight)
        if at:
            b, g = b * bb + g * gb, b * bg + g * gg
        g *= weight
        total = b + g
        scale += math.log(total)
        b, g = b / total, g / total
        forward.append((b, g))
    marginals = [0.0] * len(scores)
    moves = [0.0] * 4
    b, g = 1.0, 1.0
    for at in range(len(scores) - 1, -1, -1):
        fb, fg = forward[at]
        total = fb * b + fg * g
        marginals[at] = fg * g / total
        if at:
            pb, pg = forward[at - 1]
            wg = g * odds[at]
            parts = (pb * bb * b, pb * bg * wg, pg * gb * b, pg * gg * wg)
            total = sum(parts)
            moves = [m + p / total for m, p in zip(moves, parts)]
            b, g = bb * b + bg * wg, gb * b + gg * wg
            total = b + g
            b, g = b / total, g / total
    return marginals, moves, scale


@dataclass
class LineField:
    """Weights of the field; without training, every line is as likely good as ``prior``."""

    prior: float = 0.5
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    move: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def _scaled(self, features: np.ndarray) -> np.ndarray:
        scaled = np.clip((features - self.mean) / self.spread, -8, 8)
        return np.hstack([scaled, np.ones((len(features), 1))])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Quality of every text, 0 to 1."""
        if self.weights is None:
            return np.full(len(texts), self.prior)
        features, sizes, counts = line_features(texts)
        odds = (self._scaled(features) @ self.weights).tolist()
        start, move = tuple(np.exp(self.start)), tuple(np.exp(self.move))
        found, at = [], 0
        for n in counts.tolist():
            good = np.array(chain_marginals(odds[at : at + n], start, move)[0])
            size = sizes[at : at + n]
            found.append(float(good @ size / size.sum()) if size.sum() else float(good.mean()))
            at += n
        return np.clip(found, 0.0, 1.0)


def _steps(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam with a fixed number of steps."""
    at, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for n in range(1, rounds + 1):
        slope = gradient(at)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        at -= rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.99**n)) + 1e-8)
    return at


def fit_field(
    features: np.ndarray, counts: np.ndarray, labels: np.ndarray, penalty: float = 1e-3
) -> LineField:
    """The field for lines of documents whose labels (1 good, 0 bad) are given."""
    model = LineField(prior=float(np.mean(labels)) if len(labels) else 0.5)
    if not len(labels) or labels.min() == labels.max():
        return model
    model.mean, model.spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = model._scaled(features)
    per_line = np.repeat(labels, counts).astype(float)
    balance = np.where(per_line == 1, 0.5 / per_line.mean(), 0.5 / (1 - per_line.mean()))

    def line_slope(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -_REACH, _REACH)))
        return x.T @ (balance * (p - per_line)) / len(x) + penalty * w

    alone = _steps(line_slope, np.zeros(x.shape[1]), 150, 0.1)
    wanted = np.where((per_line == 0) & (x @ alone > 0), 1.0, per_line)
    ends = np.cumsum(counts)
    first = ends - counts
    seen = np.zeros(4)
    within = np.setdiff1d(np.arange(len(x)), first)
    pairs = (2 * wanted[within - 1] + wanted[within]).astype(int)
    seen += np.bincount(pairs, minlength=4)
    seen_start = np.array([np.sum(wanted[first] == 0), np.sum(wanted[first] == 1)], float)
    spans = list(zip(first.tolist(), ends.tolist()))

    def chain_slope(p: np.ndarray) -> np.ndarray:
        odds = (x @ p[:-6]).tolist()
        start, move = tuple(np.exp(p[-6:-4])), tuple(np.exp(p[-4:]))
        good, moves, starts = np.empty(len(x)), np.zeros(4), np.zeros(2)
        for a, b in spans:
            marginals, expected, _ = chain_marginals(odds[a:b], start, move)
            good[a:b] = marginals
            moves += expected
            starts += (1 - marginals[0], marginals[0])
        slope = np.concatenate([x.T @ (good - wanted), starts - seen_start, moves - seen])
        return slope / len(x) + penalty * p

    fitted = _steps(chain_slope, np.concatenate([alone, np.zeros(6)]), 40, 0.05)
    model.weights, model.start, model.move = fitted[:-6], fitted[-6:-4], fitted[-4:]
    return model


def remainder(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % parts


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = 1500,
    most_lines: int = 300,
) -> LineField:
    """Fit the field on at most ``per_label`` documents of each label.

    ``labels`` should hold the rows to learn from. The documents are those with the least
    hash of the id. Of a document with more than ``most_lines`` lines the fit takes so many
    in a row, from a place that a hash of its text chooses; scoring always takes all lines.
    So at most 2 * per_label * most_lines lines' features (250 MB) reach the driver. An id
    with several labels counts as bad. Runs jobs.
    """
    known = (
        labels.select(named_column(id_col).alias("id"), named_column(label_col).alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("id").agg(F.min("label").cast("int").alias("label"))
        .withColumn("order", F.xxhash64("id"))
    )
    sample = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy("order", "id").limit(per_label)
        sample = some if sample is None else sample.unionByName(some)
    sample = sample.select("id", "label")
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches):
            given = part.column("text").to_pylist()
            x, _, counts = line_features(given)
            ends = np.cumsum(counts)
            rows = []
            for text, end, n in zip(given, ends.tolist(), counts.tolist()):
                first = end - n
                if n > most_lines:
                    place = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                    first += place % (n - most_lines + 1)
                rows.append(x[first : min(first + most_lines, end)].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(rows, pa.binary())], ["label", "x"]
            )

    rows = (
        texts.select("label", "text", "id").orderBy("id")
        .mapInArrow(features, "label int, x binary").collect()
    )
    width = 3 * _OWN + _BORDER
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, width) for r in rows]
    if not parts:
        return LineField()
    return fit_field(
        np.vstack(parts).astype(float),
        np.array([len(p) for p in parts]),
        np.array([r["label"] for r in rows]),
    )


def score_quality(
    docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` ids with ``score`` (0 to 1, higher is better): (id, score) for every row.

    Lines end at line feeds; a text has at least one line, so empty and null texts get
    the score of an empty line. Texts are read whole, repeated rows stay rows, an empty
    table gives none, and columns besides id and text are never read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches):
            found = model.scores(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(found, pa.float64())], ["id", "score"]
            )

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(score, f"id {kind}, score double")


def keep_good(
    docs: DataFrame, model: LineField, text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``least``."""
    ship_package(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, text_col):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            yield part.filter(pa.array(model.scores(texts) >= least))

    return docs.mapInArrow(keep, docs.schema)
