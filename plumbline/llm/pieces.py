"""Cutting texts into the pieces within which a tokenizer merges, many texts at once.

Both cuts follow the published patterns of the two tokenizer files. They are worked out
with numpy on the code points of all texts of a slice together, which gives the same
pieces as matching the pattern text by text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex

SYMBOL, LETTER, NUMBER, SPACE = range(4)
_APOSTROPHE = ord("'")


@cache
def _class_table() -> np.ndarray:
    """Class of every code point, by the Unicode properties the patterns name."""
    table = np.full(0x110000, SYMBOL, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for run in regex.finditer(pattern, every):
            table[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    return table


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points, their classes, and where each text ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return points, _class_table()[points], ends


def _starts_of_runs(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a run of one class starts here, and whether a text starts here."""
    first = np.zeros(classes.size, bool)
    if classes.size:
        first[0] = True
        first[ends[:-1][ends[:-1] < classes.size]] = True
    starts = first.copy()
    starts[1:] |= classes[1:] != classes[:-1]
    return starts, first


def _split_contractions(
    points: np.ndarray, first: np.ndarray, starts: np.ndarray, at: np.ndarray
) -> None:
    """Let 's 't 'm 'd 're 've 'll be pieces where a piece starts with the apostrophe."""
    beyond = np.append(points, np.zeros(3, points.dtype))
    breaks = np.append(first, np.ones(3, bool))
    at = at[~breaks[at + 1]]
    one, two = beyond[at + 1], beyond[at + 2]
    whole = ~breaks[at + 2]
    pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | (
        (one == ord("l")) & (two == ord("l"))
    )
    single = np.isin(one, [ord(c) for c in "stmd"])
    for found, length in ((at[single], 1), (at[pair & whole], 2)):
        for offset in range(1, length + 1):
            starts[found + offset] = False
        after = found + length + 1
        starts[after[after < points.size]] = True


def _utf8_sizes(points: np.ndarray) -> np.ndarray:
    return (
        1
        + (points >= 0x80).astype(np.int32)
        + (points >= 0x800).astype(np.int32)
        + (points >= 0x10000).astype(np.int32)
    )


def _pieces(
    points: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces that start where told and cover everything, and how many each text has."""
    at = np.flatnonzero(starts)
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode()
    if len(data) == points.size:
        offsets = np.append(at, points.size)
    else:
        bytes_before = np.concatenate([[0], np.cumsum(_utf8_sizes(points))])
        offsets = np.append(bytes_before[at], len(data))
    pieces = pa.StringArray.from_buffers(
        at.size, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)
    )
    return pieces, np.diff(np.searchsorted(at, ends), prepend=0)


def word_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Pieces of the pattern ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``.

    White space is left out. The texts must be lower-cased already.
    """
    points, classes, ends = _code_points(texts)
    starts, first = _starts_of_runs(classes, ends)
    starts |= classes == NUMBER
    at = np.flatnonzero(starts & (points == _APOSTROPHE))
    _split_contractions(points, first, starts, at)
    kept = classes != SPACE
    kept_before = np.concatenate([[0], np.cumsum(kept)])
    return _pieces(points[kept], starts[kept], kept_before[ends])


def byte_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Pieces of ``'s|...|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    points, classes, ends = _code_points(texts)
    starts, first = _starts_of_runs(classes, ends)
    space = classes == SPACE
    # The last white space before something else is a piece or starts the next one.
    before_other = np.zeros(points.size, bool)
    before_other[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    starts |= before_other
    joins = np.flatnonzero(before_other & (points == 0x20)) + 1
    starts[joins] = False
    at = np.flatnonzero(starts & (points == _APOSTROPHE))
    _split_contractions(points, first, starts, at)
    return _pieces(points, starts, ends)


def space_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Every text after a space, cut before each run of spaces, and how many pieces it has.

    A single space at a text's end stays with what is before it; an empty text has no piece.
    """
    spelled = [f" {text}".encode() if text else b"" for text in texts]
    data = np.frombuffer(b"".join(spelled), np.uint8)
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    ends = np.cumsum(sizes)
    starts = data == 0x20
    starts[1:] &= ~(data[:-1] == 0x20)
    starts[ends[sizes > 0] - 1] = False
    starts[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(starts)
    pieces = pa.StringArray.from_buffers(
        at.size, pa.py_buffer(np.append(at, data.size).astype(np.int32).tobytes()), pa.py_buffer(data)
    )
    return pieces, np.diff(np.searchsorted(at, ends), prepend=0)


def gather(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """values[offsets[c]:offsets[c + 1]] for every c in codes, end to end."""
    sizes = np.diff(offsets)[codes]
    begin = np.cumsum(sizes) - sizes
    return values[np.repeat(offsets[:-1][codes] - begin, sizes) + np.arange(sizes.sum())]
