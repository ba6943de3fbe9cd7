"""Words of whole texts as NumPy arrays, read straight from Arrow buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D, so it never cuts a UTF-8
sequence. Each word is known by a 64-bit hash: random-looking values of its
bytes, weighted by powers of an odd number, summed and mixed.

Work goes through slices of bounded bytes. A text longer than a slice is cut at
white space, so memory follows the slice and the words, not the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray | int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible random-looking 64-bit values."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(steps + np.uint64(seed))


def _powers(base: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base & _MASK)
    return np.array(out, dtype=np.uint64)


_LONG = 64
_BASE = 0x5851F42D4C957F2D
_POWERS = _powers(_BASE, _LONG)
_BYTES = series(1, 256)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in ``data`` (bytes)."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    inside = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    if inside[-1]:
        edges = np.concatenate((edges, [len(data)]))
    return edges[0::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """The hash of each word; ``fold`` lower-cases A-Z first."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = (_FOLDED if fold else _BYTES)[data[within + np.repeat(starts, lengths)]]
    with np.errstate(over="ignore"):
        if int(lengths.max()) <= _LONG:
            values *= _POWERS[within]
        else:
            long = _powers(_BASE, int(lengths.max()))
            values *= long[within]
        sums = np.add.reduceat(values, first)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("").cast(pa.large_utf8())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw, at


def _cut(raw: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Slices of one long text that end at white space."""
    while high - low > SLICE_BYTES:
        end = low + SLICE_BYTES
        while end < high and not _SPACE[raw[end]]:
            end += 1
        yield low, end
        low = end
    yield low, high


@dataclass(frozen=True)
class Slice:
    """The words of a run of rows: hashes, their bytes, and where each row's begin."""

    first: int
    data: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        """The row (from the slice's first) of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(texts: pa.Array, fold: bool) -> Iterator[Slice]:
    """Runs of rows of about ``SLICE_BYTES`` of text. Null texts have no words."""
    raw, at = _buffers(texts)
    row, rows = 0, len(texts)
    while row < rows:
        last = int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, row + 1), rows)
        low, high = int(at[row]), int(at[last])
        if last == row + 1 and high - low > SLICE_BYTES:
            data = raw[low:high]
            parts = []
            for a, b in _cut(data, 0, len(data)):
                starts, ends = spans(data[a:b])
                parts.append((hashes(data[a:b], starts, ends, fold), starts + a, ends + a))
            words, starts, ends = (np.concatenate(x) for x in zip(*parts))
            yield Slice(row, data, words, starts, ends, np.array([0, len(words)]))
        else:
            # a document's last word must not run into the next document's first
            gap = at[row : last + 1] - low + np.arange(last + 1 - row)
            data = np.full(int(gap[-1]), 32, dtype=np.uint8)
            keep = np.ones(len(data), dtype=bool)
            keep[gap[1:] - 1] = False
            data[keep] = raw[low:high]
            starts, ends = spans(data)
            found = hashes(data, starts, ends, fold)
            yield Slice(row, data, found, starts, ends, np.searchsorted(starts, gap))
        row = last


def documents(texts: pa.Array, fold: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, word hashes of each row)`` for runs of rows."""
    for part in slices(texts, fold):
        yield part.first, np.split(part.words, part.bounds[1:-1])


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)
