"""Language of texts from piece probabilities, summed over all ways to cut a word.

Each language has a probability for every piece of a fixed public vocabulary (rank file
of a byte-level tokenizer, so any text can be cut into pieces). A run of letters, with a
space before it, has the sum over all its segmentations of the product of its pieces'
probabilities; a forward pass gives the sum. Training maximizes the likelihood of all
training words by expectation-maximization: words are counted per language once, and each
round is one pass over the different words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import by_size, id_and_text, ship_package, written
from plumbline.llm.pieces import word_pieces

UNDETERMINED = "und"
#: Distinct languages a model may have; all their tables reach driver and tasks.
MOST_LANGUAGES = 400
#: Words a Python worker keeps, in one table of floats; beyond it the table is emptied.
KEPT_WORDS = 1_000_000
_COUNTED_AT_ONCE = 500_000


class Vocabulary:
    """Pieces of a rank file (base64 token and rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.piece = {base64.b64decode(a): n for n, (a, _) in enumerate(map(bytes.split, file))}
        self.size = len(self.piece)
        # A tree of the pieces' bytes: state and byte, as one number, to the next state.
        step: dict[int, int] = {}
        ends = [-1]
        for raw, number in self.piece.items():
            state = 0
            for byte in raw:
                key = state << 8 | byte
                state = step.get(key, -1)
                if state < 0:
                    state = step[key] = len(ends)
                    ends.append(-1)
            ends[state] = number
        self.ends = np.array(ends)
        self._fill(np.fromiter(step.keys(), np.int64), np.fromiter(step.values(), np.int64))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A hash table of the tree's steps that numpy can look up many at a time."""
        self._bits = np.uint64((2 * keys.size + 1).bit_length())
        self._keys = np.full(1 << int(self._bits), -1, np.int64)
        self._next = np.full(self._keys.size, -1, np.int64)
        left, place = np.arange(keys.size), self._home(keys)
        while left.size:
            free = np.flatnonzero(self._keys[place[left]] < 0)
            slots, first = np.unique(place[left[free]], return_index=True)
            won = left[free[first]]
            self._keys[slots], self._next[slots] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & (self._keys.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> (np.uint64(64) - self._bits)).view(np.int64)

    def _step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where no piece goes on so."""
        keys = states << 8 | bytes_
        place = self._home(keys)
        found = np.full(keys.size, -1, np.int64)
        rows = np.arange(keys.size)
        while rows.size:
            there = self._keys[place[rows]]
            hit = there == keys[rows]
            found[rows[hit]] = self._next[place[rows[hit]]]
            rows = rows[~hit & (there >= 0)]
            place[rows] = (place[rows] + 1) & (self._keys.size - 1)
        return found

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every piece in every word."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        last = np.cumsum(sizes)
        begin, end = (last - sizes)[owner], last[owner]
        # All places walk the tree together, a byte at a time; most leave it soon.
        live, states, depth = np.arange(data.size), np.zeros(data.size, np.int64), 0
        places, depths, pieces = [live[:0]], [live[:0]], [live[:0]]
        while live.size:
            inside = live + depth < end[live]
            live, states = live[inside], states[inside]
            states = self._step(states, data[live + depth].astype(np.int64))
            live, states = live[states >= 0], states[states >= 0]
            depth += 1
            known = self.ends[states]
            hit = known >= 0
            places.append(live[hit])
            depths.append(np.full(places[-1].size, depth))
            pieces.append(known[hit])
        place, piece = np.concatenate(places), np.concatenate(pieces)
        start = place - begin[place]
        return owner[place], start, start + np.concatenate(depths), piece


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _sums(
    arcs: np.ndarray, word: np.ndarray, at: np.ndarray, other: np.ndarray, words: int, length: int,
    backwards: np.ndarray | None = None, logarithms: bool = False,
) -> np.ndarray:
    """Sums over paths up to (or from) each position: (words, length + 1, columns).

    ``arcs`` has the weight of each arc, or its logarithm. All arcs that end (or, given the
    words' lengths as ``backwards``, start) at one position are added up for all words.
    """
    table = np.full((words, length + 1, arcs.shape[1]), -np.inf if logarithms else 0.0)
    begins = 0 if backwards is None else backwards
    table[np.arange(words), begins] = 0.0 if logarithms else 1.0
    order = np.lexsort((word, at))
    arcs, word, at, other = arcs[order], word[order], at[order], other[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    groups = list(zip([0, *cuts], [*cuts, at.size])) if at.size else []
    for a, b in groups if backwards is None else reversed(groups):
        w = word[a:b]
        first = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
        before = table[w, other[a:b]]
        if logarithms:
            table[w[first], at[a]] = np.logaddexp.reduceat(before + arcs[a:b], first, axis=0)
        else:
            table[w[first], at[a]] = np.add.reduceat(before * arcs[a:b], first, axis=0)
    return table


#: Words of up to so many bytes are summed as probabilities, longer ones by logarithms.
_SHORT = 40
#: A byte's weight is raised by this much (natural logarithm), so that sums stay in range.
_RAISED = 8.0
_CELLS = 1 << 22


def _groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, bool]]:
    """(rows, whether they are long): words of like length, in number as memory allows."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    a = 0
    while a < order.size:
        long = bool(ordered[a] > _SHORT)
        b = a + 4096 if long else min(a + 4096, int(np.searchsorted(ordered, _SHORT, "right")))
        b = min(b, order.size)
        while b > a + 1 and (b - a) * (int(ordered[b - 1]) + 1) > _CELLS:
            b = a + (b - a) // 2
        yield order[a:b], long
        a = b


def word_log_probabilities(vocabulary: Vocabulary, words: list[bytes], logs: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations; ``logs`` is (pieces, languages)."""
    out = np.zeros((len(words), logs.shape[1]))
    for rows, long in _groups(words):
        some = [words[r] for r in rows]
        word, start, end, piece = vocabulary.arcs(some)
        size = np.fromiter(map(len, some), np.int64, len(some))
        longest, every = int(size.max()), np.arange(len(rows))
        step = max(1, _CELLS // (len(rows) * (longest + 1)))
        for a in range(0, logs.shape[1], step):
            own = logs[piece, a : a + step]
            if not long:
                own = np.exp(own + _RAISED * (end - start)[:, None])
            table = _sums(own, word, end, start, len(rows), longest, logarithms=long)
            whole = table[every, size]
            out[rows, a : a + step] = whole if long else np.log(whole) - _RAISED * size[:, None]
    return out


def expected_pieces(
    vocabulary: Vocabulary, words: list[bytes], weights: np.ndarray, language: np.ndarray,
    logs: np.ndarray,
) -> np.ndarray:
    """(pieces, languages): expected uses of every piece in words of the given languages."""
    total = np.zeros(logs.shape)
    for rows, long in _groups(words):
        some = [words[r] for r in rows]
        word, start, end, piece = vocabulary.arcs(some)
        size = np.fromiter(map(len, some), np.int64, len(some))
        spoken, n, longest = language[rows], len(rows), int(size.max())
        own = logs[piece, spoken[word]]
        if not long:
            own = np.exp(own + _RAISED * (end - start))
        ahead = _sums(own[:, None], word, end, start, n, longest, logarithms=long)[..., 0]
        behind = _sums(own[:, None], word, start, end, n, longest, size, long)[..., 0]
        whole = ahead[np.arange(n), size][word]
        if long:
            share = np.exp(ahead[word, start] + own + behind[word, end] - whole)
        else:
            share = ahead[word, start] / whole * own * behind[word, end]
        cell = piece * logs.shape[1] + spoken[word]
        np.add.at(total.reshape(-1), cell, share * weights[rows][word])
    return total


def _letters(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Runs of letters of the lower-cased texts: coded pieces, the text of each, a keep mask."""
    pieces, counts = word_pieces([t.lower() for t in texts])
    coded = pieces.dictionary_encode()
    letter = np.array([p[0].isalpha() for p in coded.dictionary.to_pylist()], bool)
    codes = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), counts)
    keep = letter[codes] if letter.size else np.zeros(0, bool)
    return coded, owner[keep], codes[keep]


def _spelled(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass")


def count_words(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, word, n): how often each run of letters occurs in the texts of a language."""
    source = id_and_text(docs, lang_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                added = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")])
                held.clear()
                yield from added.rename_columns({"n_sum": "n"}).select(
                    ["lang", "word", "n"]
                ).to_batches(max_chunksize=50_000)

        for part in by_size(batches):
            langs = part.column("id").dictionary_encode()
            coded, owner, codes = _letters(part.column("text").to_pylist())
            width = max(len(coded.dictionary), 1)
            both = langs.indices.to_numpy()[owner].astype(np.int64) * width + codes
            seen, n = np.unique(both, return_counts=True)
            held.append(pa.table({
                "lang": langs.dictionary.take(pa.array(seen // width)),
                "word": coded.dictionary.take(pa.array(seen % width)),
                "n": pa.array(n.astype(np.int64)),
            }))
            rows += seen.size
            if rows > _COUNTED_AT_ONCE:
                yield from flush()
                rows = 0
        yield from flush()

    counted = source.filter("id is not null").mapInArrow(count, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages in order, and log probabilities of the pieces (pieces, languages)."""

    def __init__(self, languages: list[str], vocabulary: str, logs: np.ndarray):
        self.languages, self.vocabulary, self.logs = languages, vocabulary, logs
        self._known: dict[str, int] = {}
        self._table = np.zeros((0, len(languages)), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_table": self._table[:0]}

    def _rows(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, worked out for those the table does not have."""
        known = self._known
        if len(known) > KEPT_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        if new:
            logs = word_log_probabilities(
                _vocabulary(self.vocabulary), list(map(_spelled, new)), self.logs
            )
            before = len(known)
            if len(self._table) < before + len(new):
                grown = np.zeros((2 * (before + len(new)), len(self.languages)), np.float32)
                grown[:before] = self._table[:before]
                self._table = grown
            self._table[before : before + len(new)] = logs
            known.update(zip(new, range(before, before + len(new))))
        return self._table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, all alike beforehand, and its probability."""
        coded, owner, codes = _letters(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        words = coded.dictionary.to_pylist()
        used = np.unique(codes)
        table = np.zeros((len(words), len(self.languages)))
        if used.size:
            table[used] = self._rows([words[c] for c in used.tolist()])
        total = np.zeros((len(texts), len(self.languages)))
        for n in range(len(self.languages)):
            total[:, n] = np.bincount(owner, table[codes, n], len(texts))
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)  # of equals the first, in order of the names
        spoken = np.bincount(owner, minlength=len(texts)) > 0
        return (
            [self.languages[b] if s else UNDETERMINED for b, s in zip(best, spoken)],
            [float(share[i, b]) if s else 0.0 for i, (b, s) in enumerate(zip(best, spoken))],
        )


def train_language(
    docs: DataFrame,
    vocabulary: str,
    lang_col: str = "lang",
    text_col: str = "text",
    rounds: int = 2,
    smoothing: float = 0.1,
) -> LanguageModel:
    """Piece probabilities of every language in ``docs``, learned from all its rows.

    Rows without language are left out; null texts count as empty. Starting from equal
    probabilities, each round gives every piece its expected uses plus ``smoothing``.
    Only the piece table, pieces times languages, passes through the driver.
    """
    counted = written(count_words(docs, lang_col, text_col), "words")
    languages = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").limit(
        MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = _vocabulary(vocabulary).size
    logs = np.full((size, len(languages)), -np.log(size))
    place = {name: n for n, name in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        now = logs.astype("<f4")

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, total = _vocabulary(vocabulary), np.zeros(now.shape)
            current = now.astype(float)
            for part in by_size(batches, "word"):
                if part.num_rows:
                    spoken = np.array([place[name] for name in part.column("lang").to_pylist()])
                    total += expected_pieces(
                        known, list(map(_spelled, part.column("word").to_pylist())),
                        part.column("n").to_numpy().astype(float), spoken, current,
                    )
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece * len(languages) + lang), pa.array(total[piece, lang])],
                ["cell", "n"],
            )

        sums = counted.mapInArrow(expect, "cell bigint, n double").groupBy("cell").agg(
            F.sum("n").alias("n")
        ).toArrow()
        total = np.zeros(size * len(languages))
        total[sums["cell"].to_numpy()] = sums["n"].to_numpy()
        total = total.reshape(size, len(languages)) + smoothing
        logs = np.log(total / total.sum(axis=0))
    return LanguageModel(languages, vocabulary, logs)


def identify_language(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score) for every row: a learned language and its probability.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    Of equally likely languages the first by name is taken. Whole texts count, repeated
    rows stay rows, an empty table gives none, other columns are never read.
    """
    ship_package(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches):
            langs, scores = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["id", "lang_pred", "score"],
            )

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(predict, f"id {kind}, lang_pred string, score double")
