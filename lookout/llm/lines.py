"""Lines of a batch of texts as numpy arrays: limits, word counts, raw and normalised hashes."""

from __future__ import annotations

import numpy as np

from .words import U, Texts, _power_tables, mix


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, independent of where it lies."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(values * power[:-1], dtype=U)))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Lines:
    """The \\n-separated lines of every text of a run; a text of n newlines has n + 1 lines."""

    def __init__(self, part: Texts):
        data, limits = part.data, part.limits
        feeds = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate((limits[:-1], feeds + 1)), kind="stable")
        self.ends = np.sort(np.concatenate((feeds, limits[1:])), kind="stable")
        # a newline at the end of a text starts its last, empty line where the next text begins
        per = np.bincount(np.searchsorted(limits, feeds, "right") - 1, minlength=part.n) + 1
        self.doc = np.repeat(np.arange(part.n), per)
        self.first_line = np.concatenate(([0], np.cumsum(per)))
        self.ordinal = np.arange(len(self.doc)) - self.first_line[self.doc]
        self.word_lo = np.searchsorted(part.starts, self.starts, "left")
        self.word_hi = np.maximum(self.word_lo, np.searchsorted(part.starts, self.ends, "left"))
        self.words = self.word_hi - self.word_lo
        self.part = part

    def raw(self) -> np.ndarray:
        """Hash of the exact bytes of every line."""
        return spans_hash(self.part.data.astype(U) + U(1), self.starts, self.ends)

    def normalised(self, seed: int = 0) -> np.ndarray:
        """Hash of the line's words in order: A-Z lower-cased, white space collapsed and trimmed."""
        return spans_hash(mix(self.part.hashes() ^ U(seed)), self.word_lo, self.word_hi)


def code_points(part: Texts) -> np.ndarray:
    """Code points before every byte position of the run (one more entry than bytes)."""
    return np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
