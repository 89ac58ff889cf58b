"""Vectorised words, word hashes and shingles of Arrow text columns, for use inside tasks.

A word is a run of digits, letters a-z and characters beyond ASCII once A-Z are lower-cased;
in UTF-8 this can be decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of the vectorised code takes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_RANDOM = np.random.default_rng(20260101)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; null is the empty text."""
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with about ``size`` bytes of text in column ``text``."""
    for batch in batches:
        data, offsets = utf8(batch.column(text))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop


class Words:
    """Words of some texts: ``start`` and ``end`` bytes, and ``first``, where each text's words begin (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[data]
        word = IS_WORD[self.low]
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = offsets[(offsets > 0) & (offsets < len(word))]
        before[edges], after[edges - 1] = False, False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.low) + 1)
        total = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum(_BYTE[self.low] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def text(self, row: int) -> str:
        """The words of one text, joined by single spaces."""
        a, b = self.first[row], self.first[row + 1]
        return " ".join(self.low[s:e].tobytes().decode() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of each text, and where each text's begin (n_texts + 1).

    A text of 1 to n - 1 words has one run: all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate(([0], np.cumsum(runs)))
    at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += padded[at + k] * _STEP[k]
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        run = h[first[row] : first[row + 1]]
        out[begin[row]] = (run * _STEP[: len(run)]).sum(dtype=np.uint64) + np.uint64(len(run))
    return mix(out), begin
