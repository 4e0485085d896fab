"""Words, word hashes and word shingles of a batch of texts, as numpy arrays.

Works on the UTF-8 bytes of an Arrow string column.  A word is a maximal run of
bytes other than space and 0x09-0x0D, which is the same as a run of such code
points because those bytes never occur inside a multi-byte character.  Hashes
are taken after lower-casing A-Z.  Everything is deterministic across processes.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(_BASE))


class Texts:
    """A run of texts: lower-cased bytes, text limits, and the words inside."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        self.data, self.limits, self.n = data, limits, len(limits) - 1
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[limits] = True
        word = ~_SEP[data]
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0] = True
            before[1:] = ~word[:-1]
            after[-1] = True
            after[:-1] = ~word[1:]
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.doc = np.searchsorted(limits, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n)
        #: index of the first word of each text, and the number of words after the last
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.is_word = word

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        power, inverse = _power_tables(len(self.data) + 1)
        terms = (_LOWER[self.data].astype(U) + U(1)) * power[:-1]
        sums = np.concatenate((np.zeros(1, U), np.cumsum(terms, dtype=U)))
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93))

    def window_hashes(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``size`` consecutive words of one text, and the index of its first word."""
        if len(h) < size:
            return np.zeros(0, U), np.zeros(0, np.int64)
        out = np.zeros(len(h) - size + 1, U)
        for k, c in enumerate(constants(size, 7)):
            out += h[k : k + len(out)] * (c | U(1))
        whole = np.flatnonzero(self.doc[: len(out)] == self.doc[size - 1 :])
        return mix(out[whole]), whole

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of every text, text by text, and their count by text.

        A text of fewer than ``size`` words has its whole sequence as one shingle;
        a text without words has none.
        """
        h = self.hashes()
        wide, at = self.window_hashes(h, size)
        per = np.maximum(self.counts - size + 1, 0)
        limits = np.concatenate(([0], np.cumsum(per)))
        c = constants(size, 7) | U(1)
        found: list[np.ndarray] = []
        counts = np.zeros(self.n, np.int64)
        for k in range(self.n):
            n = int(self.counts[k])
            if n >= size:
                own = np.sort(wide[limits[k] : limits[k + 1]])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif n:
                own = h[self.first[k] : self.first[k] + n] * c[:n]
                own = mix(own.sum(dtype=U, keepdims=True) + U(n * 0xA0761D6478BD642F % (1 << 64)))
            else:
                continue
            counts[k] = len(own)
            found.append(own)
        return (np.concatenate(found) if found else np.zeros(0, U)), counts


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """Runs of at most ``chunk`` bytes (or one text) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(limits, limits[lo] + chunk, "right")) - 1)
        own = limits[lo : hi + 1]
        yield lo, hi, Texts(data[own[0] : own[-1]], own - own[0])
        lo = hi


def runs(batch: pa.RecordBatch, k: int, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``chunk`` bytes of text (or one row) in column ``k`` each, so
    that what is made of them is handed on bit by bit."""
    ends = np.cumsum(pc.binary_length(batch.column(k)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = done = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + chunk, "right")))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(ends[hi - 1])


def release() -> None:
    """Give back what this worker has freed.  Workers outlive their tasks, and what allocators keep
    for later would count against the executor in the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """``run`` for ``mapInArrow``, giving memory back when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task
