"""Words and word hashes of whole text columns, computed on Arrow buffers with numpy.

Tasks read a column in pieces of a bounded number of bytes, so memory does not depend on how
many rows an Arrow batch holds. A single longer text is a piece of its own; its words are
hashed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BLOCK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

# Bytes that stand between words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


NOT_SPACE = _table(lambda b: b not in SPACE_BYTES)
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LETTER = _table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Piece:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each row starts and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def pieces(column: pa.Array, limit: int = PIECE, rows: int = 1 << 30) -> Iterator[Piece]:
    """Cut a string column in runs of at most ``rows`` rows and about ``limit`` bytes. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield Piece(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters as UTF-8 writes them."""
    low = LOWER[data]
    if len(low) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][upper] += 32
    return low


@dataclass
class Words:
    """Words of a piece: byte ranges, hashes, and for each row the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # row i holds words first[i] to first[i + 1]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_ranges(piece: Piece, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the first word of each row; no word crosses rows."""
    inside = table[piece.data]
    n = len(inside)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = np.zeros(n + 1, dtype=bool)
    finish[1:n] = inside[:-1] & ~inside[1:]
    if n:
        finish[n] = inside[-1]
        cut = piece.offsets[(piece.offsets > 0) & (piece.offsets < n)]
        begin[cut] |= inside[cut]
        finish[cut] |= inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish)
    return starts, ends, np.searchsorted(starts, piece.offsets, side="left")


def range_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range. Ranges are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, side="right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _POWERS.upto(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((folded[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def words(piece: Piece, table: np.ndarray, fold=LOWER.__getitem__) -> Words:
    starts, ends, first = word_ranges(piece, table)
    return Words(starts, ends, range_hashes(fold(piece.data), starts, ends), first)


_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int, offsets: tuple[int, ...] | None = None) -> np.ndarray:
    """Hash of every window of ``size`` words, or of the words at ``offsets`` in it."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for at in range(size) if offsets is None else offsets:
        total += hashes[at : at + n] * _MULTIPLIERS[at % 64] ^ np.uint64(at // 64)
    return mix(total)


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row with fewer words is one shingle."""
    windows = window_hashes(w.hashes, size)
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= size:
            yield np.unique(windows[a : b - size + 1])
        elif b > a:
            yield window_hashes(w.hashes[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.empty(0, dtype=np.uint64)


def long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of longs from 64-bit arrays."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64)))
