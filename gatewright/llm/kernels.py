"""Vectorised byte kernels for Arrow functions: cutting, word finding and word hashing.

All work on the UTF-8 bytes of whole texts. A text longer than ``PIECE`` bytes is handled in
pieces, so that memory is bounded by the piece and not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of words ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: The separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in text whose A-Z are lower-cased.
PUNCT = np.zeros(256, dtype=bool)
PUNCT[0x00:0x30] = PUNCT[0x3A:0x61] = PUNCT[0x7B:0x80] = True
#: The same, in text as it is written: where it may be cut.
PUNCT_RAW = PUNCT.copy()
PUNCT_RAW[65:91] = False

_P = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}


@dataclass
class Piece:
    """Bytes of consecutive texts; ``bounds`` has one more entry than ``rows``."""

    data: np.ndarray
    bounds: np.ndarray
    rows: np.ndarray
    #: The first of the texts goes on from the piece before.
    goes_on: bool
    #: The last of the texts goes on in the next piece.
    cut: bool


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column: pa.Array, size: int = PIECE, separators: np.ndarray | None = None) -> Iterator[Piece]:
    """Runs of texts of at most ``size`` bytes; a longer text is cut, after a separator if they are given.

    A text with no separator in ``size`` bytes is taken up to its next one, so that no word or
    sentence is ever cut.
    """
    data, offsets = column_bytes(column)
    n, row = len(column), 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        if end > row:
            yield Piece(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], np.arange(row, end), False, False)
            row = end
            continue
        at, last, first = int(offsets[row]), int(offsets[row + 1]), True
        while at < last:
            to = min(at + size, last)
            if separators is not None and to < last:
                found = np.flatnonzero(separators[data[at:to]])
                if len(found):
                    to = at + 1 + int(found[-1])
                else:
                    while to < last and not separators[data[to - 1]]:
                        to += 1
            yield Piece(data[at:to], np.array([0, to - at]), np.array([row]), not first, to < last)
            at, first = to, False
        row += 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, PIECE)
        for k, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[k] = np.cumprod(steps, dtype=np.uint64)
    return _POW["p"][:n], _POW["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never reaches over the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[firsts] = False
    after[firsts[firsts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over all bytes, then a finaliser. Never 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h[h == 0] = 1
    return h


def word_hash(word: bytes) -> int:
    """``word_hashes`` for one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])
