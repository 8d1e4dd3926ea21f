"""Word and shingle hashes of whole columns of text, straight from Arrow buffers.

A word is a maximal run without ASCII white space (or any other set of
separator bytes), its letters A-Z lower-cased.  Its hash is a polynomial over
random 64-bit values of its bytes, so all words of a batch are hashed by a few
array operations, with no Python string per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATED = bytes(b for b in range(128) if not chr(b).isalnum())
#: Bytes of text hashed at once; a longer text is hashed in pieces.  A worker needs some forty times as many bytes meanwhile.
PIECE = 1 << 18

_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, U)
    steps[0] = U(1)
    return np.multiply.accumulate(steps)


_TABLES: dict[object, np.ndarray] = {}


def _table(name: object, make) -> np.ndarray:
    if name not in _TABLES:
        _TABLES[name] = make()
    return _TABLES[name]


#: How to forget what a worker keeps for other kinds of work; it goes when texts are hashed.
KEPT: list[Callable[[], None]] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _byte_values(separators: bytes) -> np.ndarray:
    """Random value per byte, the same for both cases of A-Z; 0 for separators."""

    def make() -> np.ndarray:
        values = mix(np.arange(1, 257, dtype=U) * _BASE)
        values[65:91] = values[97:123]
        values[list(separators)] = 0
        return values

    return _table(("values", separators), make)


def _is_separator(separators: bytes) -> np.ndarray:
    def make() -> np.ndarray:
        out = np.zeros(256, bool)
        out[list(separators)] = True
        return out

    return _table(("separators", separators), make)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _hash_piece(data: np.ndarray, breaks: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of ``data``; a word also starts at each of ``breaks``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sep = _is_separator(separators)[data]
    start = ~sep
    after = np.empty(n, bool)
    after[0] = True
    after[1:] = sep[:-1]
    after[breaks[breaks < n]] = True
    start &= after
    starts = np.flatnonzero(start)
    if len(starts) == 0:
        return np.zeros(0, U), starts
    size = 1 << max(16, int(n - 1).bit_length())
    values = _byte_values(separators)[data]
    values *= _table(("powers", size), lambda: _powers(_BASE, size))[:n]
    sums = np.add.reduceat(values, starts)
    sums *= _table(("inverse", size), lambda: _powers(_INVERSE, size))[starts]
    return mix(sums), starts


def groups(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of text: word hashes, each word's start byte, and where each row's words begin.

    The last has one entry more than there are rows.  Memory is bounded by
    PIECE bytes of text at a time, plus 16 bytes a word for the result.
    """
    while KEPT:
        KEPT.pop()()
    begin, end = int(offsets[0]), int(offsets[-1])
    hashes, starts = [], []
    at = begin
    while at < end:
        to = min(end, at + PIECE)
        if to < end and to not in offsets:
            # Cut a long text where a word ends; a word longer than a piece is taken whole.
            sep = _is_separator(separators)
            back = np.flatnonzero(sep[data[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(sep[data[to:end]])
                to = min([to + int(ahead[0]) if len(ahead) else end, *(int(o) for o in offsets[offsets > at][:1])])
        inside = offsets[(offsets >= at) & (offsets < to)] - at
        h, s = _hash_piece(data[at:to], inside, separators)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return h, s, np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words, and where each row's begin.

    A row with fewer words, but some, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    n = len(words)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    multipliers = mix(np.arange(1, size + 1, dtype=U))
    multipliers |= U(1)
    rolled = np.zeros(n, U)
    rolled += words * multipliers[0]
    for k in range(1, size):
        rolled[: max(n - k, 0)] += mix_light(words[k:], k) * multipliers[k]
    short = (counts > 0) & (counts < size)
    keep = np.ones(n, bool)
    # The last size - 1 places of a row start no shingle.
    for k in range(1, size):
        tails = first[1:] - k
        keep[tails[(counts >= k)]] = False
    out_counts = np.maximum(counts - size + 1, 0)
    hashed = mix(rolled)
    for r in np.flatnonzero(short):
        a, b = first[r], first[r + 1]
        # Another sum than that of a full run, so that no short text equals a run.
        hashed[a] = mix((mix(words[a:b] + np.arange(1, b - a + 1, dtype=U)) * multipliers[: b - a]).sum(keepdims=True) + U(b - a))[0]
        keep[a] = True
    out_counts[short] = 1
    return hashed[keep], np.concatenate([[0], np.cumsum(out_counts)])


def mix_light(h: np.ndarray, k: int) -> np.ndarray:
    """Word hashes that depend on the word's place in a shingle."""
    return h ^ (h >> U(29 + k % 8))


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and where each row's begin."""
    rows = len(first) - 1
    if len(values) == 0:
        return values, np.zeros(rows + 1, np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    out = np.empty_like(values)
    for r in range(rows):
        a, b = first[r], first[r + 1]
        out[a:b] = np.sort(values[a:b])
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=rows))])


def fold(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values, wrapping; 0 for a row without."""
    sums = np.concatenate([[U(0)], np.cumsum(values, dtype=U)])
    return sums[first[1:]] - sums[first[:-1]]
