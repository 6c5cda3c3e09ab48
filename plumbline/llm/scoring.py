"""Text probability from bit predictors over hashed contexts, mixed by gated weights.

Texts are tokens, spelled byte by byte with a closing mark, bit by bit. Six predictors
each count the next bit in a context of their own, hashed into a table: the position, the
last one to four bytes of the token, and all of it so far. Their log odds are mixed by
weights that a gate chooses (how long a context is known, which bit), the weights learn
online from each prediction's error, and an adaptive table of outcomes refines the mix.

Since these contexts end at the token, a token's probability is computed once and serves
all its occurrences. Kinds of documents differ in their tokens, so the probability is also
tilted towards each kind, in which a document's most frequent token (often a short word of
its language) places the training documents; which kind a text is, is left to the mixing.
A document then adapts it online to what it has said so far: after t
tokens, n of them this one, the next is it with probability (n + a p) / (t + a). Several
paces a are mixed, their weights again set by how well each has predicted the document;
such a product depends on the document's token counts alone.

Word order enters through the token before: in the training texts the token b came c times
and this token c' times right after it, so it is next with probability
(c' + s e) / (c + s), where e is one of the adapted probabilities above and s grows with
c. These are mixed with the others in the same way, by how well they predict the document.

What grows with the corpus stays distributed:

- texts become rows of many documents at a time: their different tokens, and which
  document has which token how often;
- each row sends its different tokens, packed, to the tasks that their hashes fall to, where
  they are counted over all rows; bit counts are gathered from all tokens;
- each token's count and probability goes back to the rows that asked for it, by the places
  they sent. A frequent token is asked for once per row, not once per document;
- pairs of tokens in sequence are counted exactly, by a hash of 64 bits: each row sends its
  different pairs to the tasks that their hashes fall to, and gets back their counts.

The bit counts are the one thing every task has whole; their size is fixed by ``SLOTS``.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import gathered, packed_planes, ship_package, unpacked_planes, written

#: Slots per predictor, as powers of two: position, 1 to 4 bytes, the whole token so far.
SLOTS = (16, 16, 19, 20, 21, 21)
ORDERS = len(SLOTS)
_MARK = b" "
_SHORT_TOKEN, _MATRIX_BYTES = 63, 1 << 21
_TEXT_AT_ONCE = 1 << 24
_TILT_STEPS = 32
_LANES = 1 << 15
_LEARNED_AT_ONCE = 1 << 13
_BINS = 33
_BIN_SPAN = 8.0
_SEGMENTS = 64
_TRUST = 8
_GATES = (ORDERS + 1) * (_TRUST + 1) * 8
_CERTAIN = 1e-7
_PRIOR = 0.4
_SHORT_PRODUCT = 12
#: Paces of adapting to a document: tokens until its own counts weigh as much as the model.
PACES = (10.0, 100.0, 400.0, 2000.0, 20000.0)
#: Weights of the adapted probability next to the counts after a token: times the root of its uses.
STRENGTHS = (1.0, 4.0)
#: The paces that are mixed with the counts after a token.
FOLLOWED = PACES[1:4]
_PAIRS_AT_ONCE = 1 << 21
#: Uses within a row from which a token is numbered by them.
_FREQUENT = 8
_TOKENS_AT_ONCE, _BYTES_AT_ONCE = 1 << 20, 1 << 27
_PLACES_AT_ONCE = 1 << 15
_HASHED_AT_ONCE = 1 << 18
#: Positions of whole documents, or of one, that are scored together.
_SCORED_AT_ONCE = 1 << 19
_ANSWERS_AT_ONCE = 1 << 18
#: Counts of a task are held in 32 bits up to here.
_NARROW = 1 << 32
#: Kinds of documents, by their most frequent token; token frequencies are kept for each.
KINDS = 8
# Odd multipliers of published 64-bit mixers (splitmix64).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FIRST = np.concatenate([[0], np.cumsum([1 << n for n in SLOTS])])
_SHIFT = np.array([64 - n for n in SLOTS], np.uint64)


def _lanes(
    tokens: list[bytes],
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of tokens, marks around them, in their order as bytes within classes of length:
    the bytes as a matrix, lengths, shared beginnings.

    Tokens that begin alike have the same contexts there; ``shared`` is how many bytes a
    token has in common with the one before it, so each beginning is worked out once.
    Long tokens have lanes of their own, of fewer rows, so a matrix is bounded in size.
    """
    spelled = [_MARK + token + _MARK for token in tokens]
    size = [max(len(s) - 1, _SHORT_TOKEN).bit_length() for s in spelled]
    order = sorted(range(len(spelled)), key=lambda n: (size[n], spelled[n]))
    a = 0
    while a < len(order):
        b = a + min(_LANES, max(_MATRIX_BYTES >> size[order[a]], 1))
        rows = np.array([r for r in order[a:b] if size[r] == size[order[a]]])
        a += len(rows)
        lengths = np.array([len(spelled[r]) for r in rows])
        width = int(lengths.max())
        matrix = np.frombuffer(
            b"".join(spelled[r].ljust(width, b"\0") for r in rows), np.uint8
        ).reshape(-1, width)
        shared = np.zeros(len(rows), np.int64)
        alike = np.logical_and.accumulate(matrix[1:] == matrix[:-1], axis=1).sum(axis=1)
        shared[1:] = np.minimum(alike, np.minimum(lengths[1:], lengths[:-1]))
        yield rows, matrix, lengths, shared


def _walk(
    matrix: np.ndarray, lengths: np.ndarray, shared: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every bit of every byte, for every different beginning: its slots and its bit.

    With them come the rows that still go on there, and the first row of each beginning;
    the rows after it, up to the next first row, have the same beginning.
    """
    n, width = matrix.shape
    whole = np.zeros(n, np.uint64)
    salt = np.arange(1, ORDERS + 1, dtype=np.uint64) * _M2
    for at in range(1, width):
        going = lengths > at
        first = np.flatnonzero(going & (shared <= at))
        whole = (whole + matrix[:, at - 1] + np.uint64(1)) * _M1
        whole ^= whole >> np.uint64(29)
        contexts = np.empty((first.size, ORDERS), np.uint64)
        contexts[:, 0] = min(at, 8)
        past = np.zeros(first.size, np.uint64)
        for order in range(1, 5):
            if order <= at:
                past |= matrix[first, at - order].astype(np.uint64) << np.uint64(8 * (order - 1))
            contexts[:, order] = past
        contexts[:, 5] = whole[first]
        contexts = (contexts + salt) * _M1
        contexts ^= contexts >> np.uint64(31)
        byte = matrix[first, at].astype(np.int64)
        node = np.ones(first.size, np.int64)
        for bit in range(7, -1, -1):
            hashed = (contexts + node.astype(np.uint64)[:, None] * _M2) * _M1
            slots = (hashed >> _SHIFT).astype(np.int64) + _FIRST[:-1]
            value = (byte >> bit) & 1
            yield bit, slots, value, going, first
            node = 2 * node + value


def count_bits(
    tokens: list[bytes], uses: np.ndarray, table: np.ndarray | None = None
) -> np.ndarray:
    """(slots, 2): how often each bit followed in each slot, over all uses of the tokens.

    Added to ``table``, if there is one."""
    table = np.zeros((_FIRST[-1], 2), np.int64) if table is None else table
    flat = table.reshape(-1)
    for rows, matrix, lengths, shared in _lanes(tokens):
        weight = uses[rows].astype(np.int64)
        for bit, slots, value, going, first in _walk(matrix, lengths, shared):
            if bit == 7:
                some = np.add.reduceat(weight * going, first).astype(flat.dtype)
            np.add.at(flat, (slots * 2 + value[:, None]).reshape(-1), np.repeat(some, ORDERS))
    return table


def _stretch(counts: np.ndarray) -> np.ndarray:
    return np.log(counts[..., 1] + _PRIOR) - np.log(counts[..., 0] + _PRIOR)


def _trust(total: np.ndarray) -> np.ndarray:
    """Step of a context by how often it was seen: 0 for never, then by powers of two."""
    return np.minimum(np.frexp(total)[1], _TRUST).astype(np.uint8)


def _gate(trust: np.ndarray, bit: int) -> np.ndarray:
    """Chosen by the longest known context, how well it is known, and the bit."""
    found = np.zeros(len(trust), np.int64)
    for order in range(ORDERS):
        step = trust[:, order]
        np.copyto(found, (order + 1) * (_TRUST + 1) + step.astype(np.int64), where=step > 0)
    return found * 8 + bit


def _mixed(inputs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    dot = np.einsum("ij,ij->i", inputs, weights)
    return np.clip(1 / (1 + np.exp(-np.clip(dot, -30, 30))), _CERTAIN, 1 - _CERTAIN)


def _bins(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each probability between two of the refining table's bins."""
    place = (np.clip(np.log(p / (1 - p)), -_BIN_SPAN, _BIN_SPAN) / _BIN_SPAN + 1) * (_BINS - 1) / 2
    low = np.minimum(place.astype(np.int64), _BINS - 2)
    return low, place - low


def _spread(values: np.ndarray, first: np.ndarray, going: np.ndarray) -> np.ndarray:
    """Each beginning's value for all rows that have it, 0 for rows that have ended."""
    place = np.zeros(going.size, np.int64)
    place[first] = 1
    return np.where(going, values[np.maximum(np.cumsum(place) - 1, 0)], 0.0)


class Mixer:
    """Weights per gate and outcome counts per gate and bin."""

    def __init__(self):
        self.weights = np.full((_GATES, ORDERS), 0.1)
        longest = np.arange(_GATES) // (8 * (_TRUST + 1))
        self.weights[np.arange(_GATES)[longest > 0], longest[longest > 0] - 1] = 0.7
        self.steepness = np.full((_GATES, ORDERS), 1e-4)
        centre = 1 / (1 + np.exp(-np.linspace(-_BIN_SPAN, _BIN_SPAN, _BINS)))
        self.outcomes = np.tile(np.stack([1 - centre, centre], axis=-1) * 8, (_GATES, 1, 1))

    def refined(self, p: np.ndarray, gate: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """With the share of ones ``seen`` in every gate and bin, one after the other."""
        low, part = _bins(p)
        at = gate * _BINS + low
        table = (1 - part) * seen[at] + part * seen[at + 1]
        return np.clip((p + table) / 2, _CERTAIN, 1 - _CERTAIN)

    def learn(self, tokens: list[bytes], uses: np.ndarray, table: np.ndarray, rate: float = 0.04):
        """One online pass; every use is predicted from the counts of all other uses."""
        self.learn_from(tokens, uses, others_odds(table), rate)

    def learn_from(
        self, tokens: list[bytes], uses: np.ndarray, others: tuple[np.ndarray, np.ndarray],
        rate: float = 0.04,
    ):
        """The pass, with what ``others_odds`` gives."""
        known = uses > 0
        tokens = [t for t, k in zip(tokens, known) if k]
        uses = uses[known].astype(np.float64)
        flat = self.outcomes.reshape(-1)
        # Mixed well and in small groups, so that no step sees one corner of the tokens only.
        order = np.random.default_rng(len(tokens)).permutation(len(tokens))
        for a in range(0, order.size, _LEARNED_AT_ONCE):
            some_tokens = order[a : a + _LEARNED_AT_ONCE]
            self._learn_group(
                [tokens[n] for n in some_tokens], uses[some_tokens], *others, rate, flat
            )

    def _learn_group(self, tokens, uses, odds, trust, rate, flat) -> None:
        odds, columns = odds.reshape(-1), np.arange(ORDERS)
        for rows, matrix, lengths, shared in _lanes(tokens):
            weight = uses[rows]
            for bit, slots, value, going, first in _walk(matrix, lengths, shared):
                if bit == 7:
                    some = np.add.reduceat(weight * going, first)
                inputs, gate = odds.take(slots * 2 + value[:, None]), _gate(trust.take(slots), bit)
                p = _mixed(inputs, self.weights.take(gate, axis=0))
                slope = inputs * ((value - p) * some)[:, None]
                mass = np.maximum(np.bincount(gate, some, _GATES), 1e-9)
                cell = (gate[:, None] * ORDERS + columns).reshape(-1)
                step = np.bincount(cell, slope.reshape(-1), _GATES * ORDERS).reshape(_GATES, ORDERS)
                step /= mass[:, None]
                self.steepness += step * step
                self.weights += rate * step / np.sqrt(self.steepness)
                low, part = _bins(p)
                at = (gate * _BINS + low) * 2 + value
                np.add.at(flat, at, some * (1 - part))
                np.add.at(flat, at + 2, some * part)

    def log10(self, tokens: list[bytes], odds: np.ndarray, trust: np.ndarray) -> np.ndarray:
        """log10 of every token's probability, from the slots' log odds and trust."""
        found = np.zeros(len(tokens))
        seen = (self.outcomes[..., 1] / self.outcomes.sum(axis=-1)).reshape(-1)
        for rows, matrix, lengths, shared in _lanes(tokens):
            total = np.zeros(len(rows))
            for bit, slots, value, going, first in _walk(matrix, lengths, shared):
                gate = _gate(trust.take(slots), bit)
                p = self.refined(_mixed(odds.take(slots), self.weights.take(gate, axis=0)), gate, seen)
                told = np.log10(np.where(value == 1, p, 1 - p))
                byte = told if bit == 7 else byte + told
                if bit == 0:
                    total += _spread(byte, first, going)
            found[rows] = total
        return found


def slot_odds(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and trust of every slot."""
    odds, trust = np.empty(len(table), np.float32), np.empty(len(table), np.uint8)
    for at in _stretches(table):
        odds[at], trust[at] = _stretch(table[at]), _trust(table[at].sum(axis=1))
    return odds, trust


def _stretches(table: np.ndarray) -> list[slice]:
    """Parts of the table small enough that what is made of them on the way stays small."""
    return [slice(a, a + (1 << 18)) for a in range(0, len(table), 1 << 18)]


def others_odds(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and trust of every slot without one use: (slots, 2), by that use's bit, and
    (slots,). A slot's own uses see it so; slots without any are never asked for."""
    odds, trust = np.empty(table.shape, np.float32), np.empty(len(table), np.uint8)
    for at in _stretches(table):
        for bit in (0, 1):
            rest = table[at].copy()
            rest[:, bit] = np.maximum(rest[:, bit] - 1, 0)
            odds[at, bit] = _stretch(rest)
        trust[at] = _trust(np.maximum(table[at].sum(axis=1) - 1, 0))
    return odds, trust


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of values of at least 1: Stirling's series after a shift by eight."""
    shifted = x + 8
    product = x.copy()
    for n in range(1, 8):
        product *= x + n
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    whole = (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series
    return whole - np.log(product)


def adapted(scores: np.ndarray, times: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """log10 of each document's probability, from its tokens' log10 and how often each occurs.

    ``scores`` has a column for each kind of document.
    """
    length = np.bincount(owner, times, n)
    tokens = np.bincount(owner, minlength=n)
    # The most frequent first, so that those with a k-th use more are a beginning.
    again = np.flatnonzero(times > 1)
    again = again[np.argsort(-times[again], kind="stable")]
    own, uses = owner[again], times[again]
    many = int(np.searchsorted(-uses, -_SHORT_PRODUCT))  # more uses than a product is made of
    reach = np.searchsorted(-uses, -np.arange(1, _SHORT_PRODUCT), side="left")
    found = []
    for kind in range(scores.shape[1]):
        natural = scores[:, kind] * math.log(10)
        one = np.bincount(owner, natural, n)
        spoken = np.exp(np.minimum(natural[again], 600))
        for pace in PACES:
            # Gamma(n + a p) / Gamma(a p), with Gamma(a p) = Gamma(1 + a p) / (a p).
            mass = spoken * pace
            product = np.ones(again.size - many)
            for k, end in enumerate(reach, 1):
                product[: max(end - many, 0)] *= mass[many : max(end, many)] + k
            more = np.empty(again.size)
            more[many:] = np.log(product)
            more[:many] = _log_gamma(uses[:many] + mass[:many]) - _log_gamma(1 + mass[:many])
            spent = _log_gamma(1 + length + pace) - np.log(length + pace)
            begun = _log_gamma(np.array([1 + pace])) - math.log(pace)
            gained = one + tokens * math.log(pace) + np.bincount(own, more, n)
            found.append(gained - spent + begun)
    return (np.logaddexp.reduce(found, axis=0) - math.log(len(found))) / math.log(10)


def earlier(sequence: np.ndarray, owner: np.ndarray, different: int) -> np.ndarray:
    """How often each position's token came before it in its document."""
    key = owner * different + sequence
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    found = np.empty(key.size, np.int64)
    found[order] = np.arange(key.size) - np.repeat(start, np.diff(np.append(start, key.size)))
    return found


def followed(
    scores: np.ndarray, sequence: np.ndarray, owner: np.ndarray, n: int,
    together: np.ndarray, before: np.ndarray,
) -> np.ndarray:
    """log10 of each document's probability in its order, each token predicted from the one before.

    ``scores`` has a row for each token and a column for each kind of document,
    ``sequence`` the tokens of all positions, document by document. Of each position,
    ``together`` is how often its token came after the one before it in training, and
    ``before`` how often that one was there.
    """
    used = np.zeros(len(scores), bool)
    used[sequence] = True
    sequence = (np.cumsum(used) - 1)[sequence]
    spoken = np.ascontiguousarray(scores[used].T)
    np.power(10.0, spoken, out=spoken)
    n_before = earlier(sequence, owner, spoken.shape[1]).astype(float)
    first = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
    place = np.arange(owner.size) - np.repeat(first, np.diff(np.append(first, owner.size)))
    found = np.zeros((scores.shape[1] * len(FOLLOWED) * len(STRENGTHS), n))
    for a in range(0, sequence.size, _PLACES_AT_ONCE):
        at = slice(a, a + _PLACES_AT_ONCE)
        own, c, c_before = owner[at], together[at].astype(float), before[at].astype(float)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
        # With no use of the token before, what is adapted stands alone. Kinds differ in p only:
        # for each pace and strength the probability is a part without it and a factor of it.
        weighed = []
        for pace in FOLLOWED:
            reach = place[at] + pace
            for strength in STRENGTHS:
                s = strength * np.sqrt(1 + c_before)
                rest = s / (c_before + s) / reach
                weighed.append((c / (c_before + s) + rest * n_before[at], rest * pace))
        # Logarithms of products of as many positions in a row as can't come below 1e-300.
        least = min(factor.min() for _, factor in weighed) * spoken[:, sequence[at]].min()
        run = int(min(max(-300 / min(math.log10(max(least, 1e-300)), -1e-3), 1), 64))
        cuts = np.unique(np.concatenate([starts, np.arange(0, own.size, run)]))
        documents = np.searchsorted(cuts, starts)
        row = 0
        told = np.empty(own.size)
        for kind in range(scores.shape[1]):
            p = spoken[kind].take(sequence[at])
            for counted, factor in weighed:
                np.multiply(factor, p, out=told)
                told += counted
                if run == 1:
                    np.maximum(told, 1e-300, out=told)
                product = np.log(np.multiply.reduceat(told, cuts))
                found[row, own[starts]] += np.add.reduceat(product, documents)
                row += 1
    return (np.logaddexp.reduce(found, axis=0) - math.log(len(found))) / math.log(10)


def pairs_in(sequence: np.ndarray, different: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (the one before * different + token), and the pair of each position.

    Before a document's first token is the end, the last of the ``different`` tokens, as
    which the document before it closes.
    """
    before = tokens_before(sequence, different)
    return np.unique(before * different + sequence, return_inverse=True)


def pair_hashes(tokens: list[bytes], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, the pair of each) of pairs as ``pairs_in`` gives them."""
    own = token_hashes(tokens)
    before, token = np.divmod(pairs, len(tokens))
    hashes = own[before] * _M1 + own[token]
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def tokens_before(sequence: np.ndarray, different: int) -> np.ndarray:
    """The token before each position, as in ``pairs_in``."""
    return np.concatenate([[different - 1], sequence[:-1]])


def pairs_hashed(tokens: list[bytes], sequence: np.ndarray) -> np.ndarray:
    """The hash of each position's pair, as ``pair_hashes`` has them."""
    own = token_hashes(tokens)
    led = own * _M1
    hashes = np.empty(sequence.size, np.uint64)
    before = len(tokens) - 1
    for a in range(0, sequence.size, _HASHED_AT_ONCE):
        said = sequence[a : a + _HASHED_AT_ONCE]
        part = hashes[a : a + said.size]
        own.take(said, out=part, mode="clip")
        part[:1] += led[before : before + 1]
        part[1:] += led.take(said[:-1])
        before = int(said[-1])
    return hashes


def numbered(hashes: np.ndarray) -> np.ndarray:
    """The number of each hash among the different ones, in order.

    As ``np.unique`` gives it, with half the memory on the way."""
    order = np.argsort(hashes)
    hashes = hashes.take(order)
    new = np.zeros(hashes.size, bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    del hashes
    number = np.empty(new.size, np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32)
    return number


def counted_in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values and how often each is there; sorts ``values``, of which it needs no copy."""
    values.sort()
    starts = np.flatnonzero(np.append(values.size > 0, values[1:] != values[:-1])[: values.size])
    return values[starts], np.diff(np.append(starts, values.size))


def _release() -> None:
    """Give back what Arrow has freed: it keeps that for itself, beside what Numpy takes next."""
    pa.default_memory_pool().release_unused()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket is a range of hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def packed_tokens(tokens: pa.Array) -> tuple[bytes, bytes]:
    """Binary values as their lengths and their bytes, both compressed."""
    sizes = packed_planes(pc.binary_length(tokens).to_numpy().astype("<u4"))
    return sizes, zstandard.compress(b"".join(tokens.to_pylist()), 3)


def unpacked_tokens(sizes: bytes, spelled: bytes) -> pa.Array:
    ends = np.cumsum(unpacked_planes(sizes, "<u4"), dtype=np.int32)
    offsets = np.concatenate([np.zeros(1, np.int32), ends])
    return pa.Array.from_buffers(pa.binary(), ends.size, [
        None, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(spelled))])


def tilts(by_kind: np.ndarray, kind_totals: np.ndarray) -> np.ndarray:
    """(tokens, KINDS): how much likelier each token is in a kind, before normalizing."""
    total = by_kind.sum(axis=1, keepdims=True)
    share = np.maximum(kind_totals, 1) / max(kind_totals.sum(), 1)
    return (by_kind / share + 1.0) / (total + 1.0)


_ROWS = (
    "uses binary, ids array<bigint>, held_out array<boolean>, n_tokens array<bigint>, "
    "sequence binary, n_pairs bigint, n_different bigint, token_bytes bigint"
)
#: How a row has its different tokens.
_OPEN, _PACKED = "tokens array<binary>", "sizes binary, spelled binary"
_KIND_NAMES = [f"kind_{n}" for n in range(KINDS)]


def packed_tilts(tilted: np.ndarray) -> np.ndarray:
    """Tilts as one bigint, a byte for the log10 of each kind, in steps of 1/_TILT_STEPS."""
    steps = np.clip(np.rint(np.log10(tilted) * _TILT_STEPS), -127, 127).astype(np.int8)
    return np.ascontiguousarray(steps).view("<i8").reshape(-1)


def unpacked_tilts(packed: np.ndarray) -> np.ndarray:
    """log10 of the tilts, as they were packed."""
    steps = np.ascontiguousarray(packed.astype("<i8")).view(np.int8).reshape(-1, KINDS)
    return np.divide(steps, float(_TILT_STEPS), dtype=float)


def _in_order(coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different tokens, frequent ones first and the rest by their bytes, the number of each
    position's, and when each was met first.

    So both compress: frequent numbers are small, and rare tokens begin like those before."""
    words, said = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    times = np.bincount(said, minlength=len(words))
    order = pc.sort_indices(words).to_numpy()
    order = order[np.argsort(-np.where(times >= _FREQUENT, times, 0)[order], kind="stable")]
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words))
    return words.take(pa.array(order)), number[said], order


def _token_rows(
    docs: DataFrame, id_col: str, text_col: str, held_out: Column, packed: bool = False
) -> DataFrame:
    """Rows of many documents: their different tokens, training uses, and token counts.

    Packed, a row's tokens are two values, not an array of which the JVM makes an object each."""
    ship_package(docs.sparkSession)
    source = docs.select(
        named_column(id_col).alias("id"),
        F.coalesce(named_column(text_col), F.lit("")).alias("text"),
        held_out.alias("held_out"),
    )
    kind = source.schema["id"].dataType
    if kind.simpleString() != "bigint":
        raise ValueError("ids must be bigint")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in gathered(batches, least=_TEXT_AT_ONCE):
            split = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
            flat = pc.list_flatten(split)
            owner = pc.list_parent_indices(split).to_numpy()
            filled = pc.greater(pc.binary_length(flat), 0)
            flat, owner = flat.filter(filled), owner[filled.to_numpy(zero_copy_only=False)]
            coded = flat.dictionary_encode()
            n = part.num_rows
            n_tokens = np.bincount(owner, minlength=n) + 1  # one end for each document
            del split, flat, filled, owner
            words, said, met = _in_order(coded)
            del coded
            different = pa.concat_arrays([words, pa.array([b""], pa.binary())])
            del words
            end = len(different) - 1
            sequence = np.full(int(n_tokens.sum()), end, np.uint32)
            inner = np.ones(sequence.size, bool)
            inner[np.cumsum(n_tokens) - 1] = False
            sequence[inner] = said
            del said, inner
            _release()
            pairs = np.repeat(np.arange(n) * (end + 1), n_tokens)
            pairs += sequence
            pairs, times = counted_in_order(pairs)
            document, token = np.divmod(pairs, end + 1)
            held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            learned = ~held[document]
            # The most frequent token; of several, the one met first in this row.
            starts = np.concatenate([[0], np.flatnonzero(np.diff(document)) + 1])
            top = np.flatnonzero(times == np.maximum.reduceat(times, starts)[document])
            first = np.append(met, end)[token[top]]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(document[top])) + 1])
            top = top[first == np.minimum.reduceat(first, starts)[document[top]]]
            most = different.take(pa.array(token[top])).to_pylist()
            kind = np.array([zlib.crc32(name) % KINDS for name in most], np.int64)
            cell = token[learned] * KINDS + kind[document[learned]]
            uses = np.bincount(cell, times[learned], (end + 1) * KINDS).astype(np.int64)
            del pairs, times, document, token, learned, cell
            following = tokens_before(sequence, end + 1)
            following *= end + 1
            following += sequence
            following.sort()
            n_pairs = 1 + np.count_nonzero(following[1:] != following[:-1])
            del following
            tokens = [pa.ListArray.from_arrays(pa.array([0, end + 1], pa.int32()), different)]
            if packed:
                tokens = [pa.array([cell]) for cell in packed_tokens(different)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65]),
                 *tokens,
                 pa.array([pack(uses.astype("<i8").tobytes())]),
                 pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([held.tolist()]), pa.array([n_tokens]),
                 pa.array([packed_planes(sequence.astype("<u4", copy=False))]),
                 pa.array([n_pairs]),
                 pa.array([end + 1]), pa.array([pc.sum(pc.binary_length(different)).as_py()], pa.int64())],
                names,
            )
            del part, different, tokens, uses, sequence
            _release()

    schema = f"batch bigint, {_PACKED if packed else _OPEN}, {_ROWS}"
    names = [c.split()[0] for c in schema.split(", ")]
    return source.mapInArrow(rows, schema)


def _token_columns(rows: DataFrame) -> list[str]:
    return [c for c in ("tokens", "sizes", "spelled") if c in rows.columns]


def _tokens_of(batch: pa.RecordBatch, row: int) -> pa.Array:
    """A row's different tokens, packed or not."""
    if "tokens" in batch.schema.names:
        return batch.column("tokens")[row].values
    return unpacked_tokens(*[batch.column(c)[row].as_py() for c in ("sizes", "spelled")])


def _asked_tokens(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, places, sizes, spelled, uses): every row's tokens by their hashes, packed
    with their places in the row and their uses by kind."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = _tokens_of(batch, row)
                packed = batch.column("uses")[row].as_py()
                uses = np.frombuffer(zstandard.decompress(packed), "<i8").reshape(-1, KINDS)
                bucket = bucket_of(token_hashes(tokens.to_pylist()), buckets)
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
                made = []
                for a, b in zip(starts, np.append(starts[1:], order.size)):
                    places = order[a:b]
                    steps = np.diff(places, prepend=0).astype("<u4")
                    made.append((
                        packed_planes(steps), *packed_tokens(tokens.take(pa.array(places))),
                        packed_planes(uses[places]),
                    ))
                number = np.full(len(made), batch.column("batch")[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order[starts]]), pa.array(number),
                     *[pa.array(cells, pa.binary()) for cells in zip(*made)]],
                    ["bucket", "batch", "places", "sizes", "spelled", "uses"],
                )
                del tokens, uses, made
                _release()

    return rows.select("batch", *_token_columns(rows), "uses").mapInArrow(
        ask, "bucket bigint, batch bigint, places binary, sizes binary, spelled binary, uses binary"
    )


def _token_counts(rows: DataFrame) -> DataFrame:
    """Per bucket, a row of its different tokens in order (sizes, spelled) with their uses by kind,
    and for every batch one of the places that ask and which of these tokens each asks for."""
    size = rows.agg(
        F.coalesce(F.sum("n_different"), F.lit(0)).alias("asked"),
        F.coalesce(F.sum("token_bytes"), F.lit(0)).alias("bytes"),
    ).first()
    asked = _asked_tokens(rows, 1 + max(size["asked"] // _TOKENS_AT_ONCE, size["bytes"] // _BYTES_AT_ONCE))

    def count(found: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked_tokens(*cells) for cells in zip(found["sizes"], found["spelled"])]
        coded = pa.chunked_array(parts).dictionary_encode().chunks
        order = pc.sort_indices(coded[0].dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        total = np.zeros((len(order), KINDS), np.int64)
        which = []
        for part, uses in zip(coded, found["uses"]):
            own = rank[part.indices.to_numpy()]
            total[own] += unpacked_planes(uses, "<i8").reshape(-1, KINDS)
            which.append(packed_planes(np.diff(own, prepend=0).astype("<u4")))
        sizes, spelled = packed_tokens(coded[0].dictionary.take(order))
        del parts, coded, order, part
        _release()
        asking, none = len(found), [None] * len(found)
        return pd.DataFrame({
            "bucket": found["bucket"].iloc[0],
            "batch": [-1, *found["batch"]],
            "places": [None, *found["places"]],
            "which": [None, *which],
            "sizes": [sizes, *none],
            "spelled": [spelled, *none],
            "uses": [packed_planes(total), *none],
        }, index=range(1 + asking))

    return asked.groupBy("bucket").applyInPandas(
        count, "bucket bigint, batch bigint, places binary, which binary, sizes binary, "
        "spelled binary, uses binary"
    )


def _unpacked_counts(bucket: int, sizes: bytes, spelled: bytes, uses: bytes) -> pa.RecordBatch:
    """(token, its uses by kind, uses) of a bucket's tokens."""
    by_kind = unpacked_planes(uses, "<i8").reshape(-1, KINDS)
    columns = [pa.array(np.ascontiguousarray(by_kind[:, n])) for n in range(KINDS)]
    return pa.RecordBatch.from_arrays(
        [unpacked_tokens(sizes, spelled), *columns, pa.array(by_kind.sum(axis=1))],
        ["token", *_KIND_NAMES, "uses"],
    )


_COUNTS = ["bucket", "sizes", "spelled", "uses"]


def _flat_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            made = _unpacked_counts(*[batch.column(c)[row].as_py() for c in _COUNTS])
            yield from (made.slice(a, 20_000) for a in range(0, made.num_rows, 20_000))
            del made
            _release()


def _counted_tokens(buckets: DataFrame) -> DataFrame:
    """(token, its uses by kind, uses): a row for every different token."""
    columns = ", ".join(f"{k} bigint" for k in [*_KIND_NAMES, "uses"])
    return buckets.select(*_COUNTS).mapInArrow(_flat_counts, f"token binary, {columns}")


_ANSWER = np.dtype(
    [("place", "<u4"), ("uses", "<i8"), ("score", "<f8"), ("tilts", "<i8"), ("size", "<u4")]
)


def _packed_answers(answers: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """(batch, cells): the answers of a task's tokens to a row, packed, in order of their places.

    Answers are rows; with those who ask, buckets of cells that are dealt out to them first, by
    the same Python worker, since a second one would take its share of the executor's memory.
    """
    schema = "batch bigint, cells binary"

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.concat_batches(held)
        batch = part.column("batch").to_numpy()
        order = np.lexsort((part.column("place").to_numpy(), batch))
        cells = np.empty(order.size, _ANSWER)
        for name in _ANSWER.names:
            cells[name] = part.column(name).to_numpy()[order]
        batch = batch[order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(batch) != 0]))
        made = []
        for a, b in zip(starts, np.append(starts[1:], order.size)):
            own = cells[a:b]
            own["place"] = np.diff(own["place"], prepend=np.uint32(0))
            made.append(packed_planes(own))
        return pa.RecordBatch.from_arrays(
            [pa.array(batch[starts]), pa.array(made)], ["batch", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _ANSWERS_AT_ONCE:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    def dealt(bucket: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = unpacked_planes(bucket.column("cells")[0].as_py(), _ANSWER)
        for row in asked.select(["batch", "places", "which"]).to_pylist():
            own = cells[np.cumsum(unpacked_planes(row["which"], "<u4"), dtype=np.uint32)]
            own["place"] = np.cumsum(unpacked_planes(row["places"], "<u4"), dtype=np.uint32)
            columns = [pa.array(np.ascontiguousarray(own[name])) for name in _ANSWER.names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(own.size, row["batch"])), *columns], ["batch", *_ANSWER.names]
            )

    def answer(bucket: pa.Table, asked: pa.Table) -> pa.Table:
        made = pa.Table.from_batches(pack(dealt(bucket, asked)))
        _release()
        return made

    if asking is None:
        return answers.mapInArrow(pack, schema)
    return answers.groupBy("bucket").cogroup(asking.groupBy("bucket")).applyInArrow(answer, schema)


def _unpacked_answers(packed: list[bytes]) -> np.ndarray:
    """The cells of all places of a row, in order."""
    parts = [unpacked_planes(cells, _ANSWER) for cells in packed]
    cells = np.concatenate(parts)
    cells["place"] = np.concatenate([np.cumsum(p["place"], dtype=np.uint32) for p in parts])
    return cells[np.argsort(cells["place"])]


def _asked_pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, hashes, uses): every row's different pairs by their hashes, in order.

    A bucket is a range of hashes. Each row can work out its hashes again, so neither they
    nor the pairs' places come back with the answers.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = _tokens_of(batch, row)
                sequence = unpacked_planes(batch.column("sequence")[row].as_py(), "<u4")
                hashes = pairs_hashed(tokens.to_pylist(), sequence)
                del tokens, sequence
                held = np.array(batch.column("held_out")[row].as_py(), bool)
                held = np.repeat(held, batch.column("n_tokens")[row].values.to_numpy())
                not_learned, times = np.unique(hashes[held], return_counts=True)
                hashes, uses = counted_in_order(hashes)
                uses = uses.astype("<i8", copy=False)
                uses[np.searchsorted(hashes, not_learned)] -= times
                bucket = bucket_of(hashes, buckets)
                starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
                number = batch.column("batch")[row].as_py()
                for a, b in zip(starts, np.append(starts[1:], hashes.size)):
                    steps = np.diff(hashes[a:b], prepend=np.uint64(0)).astype("<u8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket[a]]), pa.array([number]),
                         pa.array([packed_planes(steps)]), pa.array([packed_planes(uses[a:b])])],
                        ["bucket", "batch", "hashes", "uses"],
                    )
                del hashes, uses, bucket
                _release()

    asked = rows.select("batch", *_token_columns(rows), "held_out", "n_tokens", "sequence")
    return asked.mapInArrow(
        ask, "bucket bigint, batch bigint, hashes binary, uses binary"
    )


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(batch, answers): for every row, how often its pairs came in all training texts, by
    bucket, in the order of their hashes."""
    pairs = rows.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n")).first()["n"]
    asked = _asked_pairs(rows, 1 + pairs // _PAIRS_AT_ONCE)

    def count(found: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(unpacked_planes(h, "<u8"), dtype=np.uint64) for h in found["hashes"]]
        ends = np.cumsum([h.size for h in hashes])
        _release()
        which = numbered(np.concatenate(hashes))
        del hashes
        uses = np.concatenate([unpacked_planes(u, "<i8") for u in found["uses"]])
        total = np.zeros(int(which.max()) + 1, np.int64)
        np.add.at(total, which, uses)
        del uses
        answers = np.split(total[which], ends[:-1])
        packed = [packed_planes(a.astype("<i8")) for a in answers]
        return pd.DataFrame({"bucket": found["bucket"], "batch": found["batch"], "counts": packed})

    counted = asked.groupBy("bucket").applyInPandas(
        count, "bucket bigint, batch bigint, counts binary"
    )
    return counted.groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("answers")
    )


class BitCounts:
    """The table of bit counts as tasks get it: packed, a few megabytes for most of its zeros."""

    def __init__(self, segments: dict[int, bytes]):
        self.segments = segments

    def table(self) -> np.ndarray:
        bounds = _segment_bounds()
        made = np.zeros((_FIRST[-1], 2), np.int64)
        for n, packed in self.segments.items():
            part = np.frombuffer(zstandard.decompress(packed), "<i8")
            made[bounds[n] : bounds[n + 1]] = part.reshape(-1, 2)
        return made

    def _parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        bounds = _segment_bounds()
        for n, packed in self.segments.items():
            part = np.frombuffer(zstandard.decompress(packed), "<i8").reshape(-1, 2)
            yield slice(bounds[n], bounds[n + 1]), part

    def slot_odds(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``slot_odds`` gives for the table, which is never whole."""
        odds, trust = np.zeros(_FIRST[-1], np.float32), np.zeros(_FIRST[-1], np.uint8)
        for at, part in self._parts():
            odds[at], trust[at] = slot_odds(part)
        return odds, trust

    def others_odds(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``others_odds`` gives for the table, which is never whole."""
        odds, trust = np.zeros((_FIRST[-1], 2), np.float32), np.zeros(_FIRST[-1], np.uint8)
        for at, part in self._parts():
            odds[at], trust[at] = others_odds(part)
        return odds, trust


def _segment_bounds() -> np.ndarray:
    return np.linspace(0, _FIRST[-1], _SEGMENTS + 1).astype(np.int64)


def _gathered_bits(counted: DataFrame) -> BitCounts:
    """The bit counts of all tokens: summed per segment of the table, then put together.

    Rows are (token, uses) or buckets of them, unpacked by the worker that counts."""
    bounds = _segment_bounds()
    opened = _flat_counts if "spelled" in counted.columns else iter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Several tasks share an executor's memory: 32 bits, and 64 only where they don't do.
        table, wide, most = None, None, 0
        for part in gathered(opened(batches), "token", 1 << 20):
            uses = part.column("uses").to_numpy()
            tokens = [t for t, n in zip(part.column("token").to_pylist(), uses) if n]
            if not tokens:
                continue
            uses = uses[uses > 0]
            # No slot gets more than a count for each use of a byte.
            more = sum(n * (len(t) + 1) for t, n in zip(tokens, uses.tolist()))
            table = np.zeros((_FIRST[-1], 2), np.uint32) if table is None else table
            if most + more >= _NARROW:
                wide = np.zeros(table.shape, np.int64) if wide is None else wide
                wide += table
                table[:], most = 0, 0
            if more >= _NARROW:
                count_bits(tokens, uses, wide)
            else:
                count_bits(tokens, uses, table)
                most += more
        for n, (a, b) in enumerate(zip(bounds, bounds[1:]) if table is not None else ()):
            total = table[a:b].astype("<i8") + (0 if wide is None else wide[a:b])
            packed = zstandard.compress(total.tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([packed])], ["segment", "counts"]
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for packed in rows["counts"]:
            part = np.frombuffer(zstandard.decompress(packed), "<i8")
            total = part.copy() if total is None else np.add(total, part, out=total)
        return pd.DataFrame(
            {"segment": rows["segment"].iloc[:1], "counts": [zstandard.compress(total.tobytes(), 1)]}
        )

    schema = "segment int, counts binary"
    summed = counted.mapInArrow(count, schema).groupBy("segment").applyInPandas(add, schema)
    # At most _SEGMENTS rows, of a fixed size together.
    return BitCounts({r["segment"]: bytes(r["counts"]) for r in summed.collect()})


def _learned_mixer(counted: DataFrame, bits) -> Mixer:
    """Every task learns from its tokens; weights are averaged by uses, outcomes added.

    Both are summed in Spark, cell by cell, so what reaches the driver has the size of one
    mixer however many tasks there are.
    """
    prior = Mixer()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All of the task's tokens at once, about tokens_per_file: they come in order.
        mixer, tokens, uses = Mixer(), [], []
        for batch in batches:
            tokens.extend(batch.column("token").to_pylist())
            uses.extend(batch.column("uses").to_pylist())
        if not tokens:
            return
        mixer.learn_from(tokens, np.array(uses, np.int64), bits.value.others_odds())
        mass = float(sum(uses))
        cells = np.concatenate([
            [mass], (mixer.weights * mass).ravel(), (mixer.outcomes - prior.outcomes).ravel()
        ])
        changed = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(changed), pa.array(cells[changed])], ["cell", "value"]
        )

    found = (
        counted.mapInArrow(learn, "cell bigint, value double")
        .groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    )
    cells = np.zeros(1 + prior.weights.size + prior.outcomes.size)
    cells[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    mixer, mass = Mixer(), cells[0]
    if mass:
        mixer.weights = (cells[1 : 1 + prior.weights.size] / mass).reshape(prior.weights.shape)
        mixer.outcomes = prior.outcomes + cells[1 + prior.weights.size :].reshape(prior.outcomes.shape)
    return mixer


def score_texts(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens_per_file: int = 400_000,
) -> DataFrame:
    """Log10 probabilities of all whole texts, learned from the rows not held out.

    Columns: id, held_out, n_tokens, n_known (tokens that training has), train_tokens,
    base_score (smoothed token frequencies), score (the mixed model) and n_bytes (of the
    tokens with one mark each); total bits per byte are -score * log2(10) / n_bytes.

    Token, pair and bit counts cover all training texts, and the mixing weights are fitted on
    all their tokens: each task learns from about ``tokens_per_file`` different ones, so at any
    size as far as at that one. A-Z are lower-cased; tokens are the runs of characters other
    than ASCII white space and one end. Null and empty texts are an end alone. ``held_out``
    must not be null.
    Repeated rows stay rows and count as often. With nothing to learn from, all counts are
    zero and the base score is that of unknown tokens. An empty table gives no rows;
    columns besides id, text and those ``held_out`` names are not read. Runs jobs.
    """
    spark = docs.sparkSession
    rows = written(_token_rows(docs, id_col, text_col, held_out, packed=True), "tokens")
    kinds = _KIND_NAMES
    buckets = written(_token_counts(rows), "counts")
    vocabulary = buckets.filter("sizes IS NOT NULL")
    # In order within a bucket, so that the tokens a task has at once begin alike.
    counted = _counted_tokens(vocabulary)
    totals = counted.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds],
        F.count_if(F.col("uses") > 0).alias("known"),
        F.count(F.lit(1)).alias("different"),
    ).first()
    kind_totals = np.array([totals[k] for k in kinds], float)
    # Every task holds a table of fixed size, so tasks get a good number of tokens each.
    spread = vocabulary.select(*_COUNTS).coalesce(1 + totals["different"] // tokens_per_file)
    bits = spark.sparkContext.broadcast(_gathered_bits(spread))
    # Dealt by hash, so that a task has neither more of them nor a corner of the tokens only.
    dealt = counted.filter("uses > 0").select("token", "uses").repartition(
        1 + totals["different"] // tokens_per_file, "token"
    )
    mixer = _learned_mixer(dealt, bits)
    train_tokens = int(kind_totals.sum())
    floor = math.log10(train_tokens + 0.1 * (totals["known"] + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = None
        for batch in batches:
            for row in range(batch.num_rows):
                if odds is None:
                    odds, trust = bits.value.slot_odds()
                packed = [batch.column(c)[row].as_py() for c in _COUNTS]
                made, total = [], np.zeros(KINDS)
                for part in gathered([_unpacked_counts(*packed)], "token", 1 << 20):
                    found = mixer.log10(part.column("token").to_pylist(), odds, trust)
                    by_kind = np.column_stack([part.column(k).to_numpy() for k in kinds])
                    cells = np.zeros(found.size, _ANSWER)
                    cells["uses"], cells["score"] = part.column("uses").to_numpy(), found
                    cells["tilts"] = packed_tilts(tilts(by_kind, kind_totals))
                    cells["size"] = pc.binary_length(part.column("token")).to_numpy()
                    # What tilting adds to the sum of probabilities; unknown tokens are not tilted.
                    mass = np.where(cells["uses"] > 0, 10.0**found, 0.0)
                    total += (mass[:, None] * (10 ** unpacked_tilts(cells["tilts"]) - 1)).sum(axis=0)
                    made.append(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([packed[0]]), pa.array([packed_planes(np.concatenate(made))]),
                     *[pa.array([total[n]]) for n in range(KINDS)]],
                    ["bucket", "cells", *kinds],
                )
                del part, made, cells
                _release()

    sums = ", ".join(f"{k} double" for k in kinds)
    scored = written(
        vocabulary.select(*_COUNTS).mapInArrow(score, f"bucket bigint, cells binary, {sums}"), "scores"
    )
    added = scored.agg(*[F.sum(k).alias(k) for k in kinds]).first()
    whole = np.log10([1 + (added[k] or 0.0) for k in kinds])
    # Packed, an answer takes about a third of what it does as a row of the shuffle.
    answers = _packed_answers(
        scored.select("bucket", "cells"),
        buckets.filter("sizes IS NULL").select("bucket", "batch", "places", "which"),
    )

    def total(key, answers_: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        if row.empty:
            return pd.DataFrame(columns=names)
        _release()
        cells = _unpacked_answers(list(answers_["cells"]))
        uses = np.ascontiguousarray(cells["uses"])
        scores = unpacked_tilts(cells["tilts"])
        scores -= whole
        scores += cells["score"][:, None]
        sizes = cells["size"].astype(float) + 1
        base = np.log10(uses + 0.1) - floor
        del cells
        r = row.iloc[0]
        sequence = unpacked_planes(r["sequence"], "<u4")
        pair = numbered(
            pairs_hashed(unpacked_tokens(r["sizes"], r["spelled"]).to_pylist(), sequence))
        together = np.concatenate([
            unpacked_planes(answer["counts"], "<i8") for answer in r["answers"]
        ])
        _release()
        n_tokens = np.asarray(r["n_tokens"], np.int64)
        ends = np.cumsum(n_tokens)
        # Documents are scored apart, so some at a time, which bounds what is made on the way.
        group = (ends - n_tokens) // _SCORED_AT_ONCE
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        made = []
        for a, b in zip(firsts, np.append(firsts[1:], n_tokens.size)):
            at = slice(ends[a] - n_tokens[a], ends[b - 1])
            n, said = b - a, sequence[at].astype(np.int64)
            position_owner = np.repeat(np.arange(n), n_tokens[a:b])
            own, times = np.unique(position_owner * len(uses) + said, return_counts=True)
            owner, token = np.divmod(own, len(uses))
            alone = adapted(scores[token], times.astype(float), owner, n)
            # A token is before another as often as it is used: every one but the end has one
            # after it, and the end stands for the beginning of each document.
            in_order = followed(
                scores, said, position_owner, n, together[pair[at]],
                uses[tokens_before(said, len(uses))],
            )
            score = np.logaddexp(alone * math.log(10), in_order * math.log(10)) - math.log(2)
            summed = [np.bincount(owner, v * times, n) for v in
                      ((uses > 0)[token], base[token], sizes[token])]
            made.append((*summed, score / math.log(10)))
        n_known, base_score, n_bytes, score = (np.concatenate(v) for v in zip(*made))
        return pd.DataFrame({
            "id": pd.array(list(r["ids"]), "Int64"),
            "held_out": np.array(r["held_out"], bool),
            "n_tokens": n_tokens,
            "n_known": n_known.astype(np.int64),
            "train_tokens": np.full(n_tokens.size, train_tokens, np.int64),
            "base_score": base_score,
            "score": score,
            "n_bytes": n_bytes.astype(np.int64),
        })

    schema = (
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, n_bytes bigint"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    asking = rows.select("batch", "ids", "held_out", "n_tokens", "sequence", "sizes", "spelled")
    packed = asking.join(_pair_counts(rows), "batch").withColumnRenamed("batch", "row_batch")
    return answers.groupBy("batch").cogroup(packed.groupBy("row_batch")).applyInPandas(total, schema)
