"""Subword lattice of a unigram piece vocabulary: forward sums and expected piece counts.

A word is one space (its start mark) followed by its UTF-8 bytes.  Edges of its lattice are the
vocabulary's pieces found in it; a byte that is no piece by itself has its byte piece, so every
word has a path.  Pieces hold the mark at their start only, so a text's lattice is the chain of
its words' lattices.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .words import U, mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOOM = 22
#: Words of one length that are handled at once, as bytes of text.
_BLOCK = 1 << 16
#: Expected counts of words up to this many bytes are summed without logarithms.
SHORT = 40
#: Positions of a long word whose edges are held at once.
STRIP = 4096


class Vocabulary:
    """Pieces as bytes (start mark as a space), each with one id; the last id ends a text."""

    def __init__(self, pieces: Iterable[bytes]):
        single = {bytes([b]) for b in range(256)}
        given = [p for p in dict.fromkeys(pieces) if p and b" " not in p[1:]]
        self.pieces = given + sorted(single - set(given))
        self.end = len(self.pieces)
        self.longest = max(map(len, self.pieces))
        power = [pow(_BASE, k, 1 << 64) for k in range(self.longest)]
        keys = np.array([sum((b + 1) * w for b, w in zip(p, power, strict=False)) % (1 << 64) for p in self.pieces], U)
        keys = mix(keys + np.array([len(p) for p in self.pieces], U) * U(_INVERSE))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.bloom = np.zeros(1 << _BLOOM, bool)
        self.bloom[(keys >> U(64 - _BLOOM)).astype(np.int64)] = True

    @classmethod
    def from_sentencepiece(cls, path: str) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary of a model file and first weights read off its scores.

        The scores of a merge vocabulary are negative ranks; a piece of rank r is taken to
        be as likely as 1 / (r + 2).  Pieces that the file does not rank get the least weight.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks: dict[bytes, float] = {}
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
                ranks.setdefault(model.id_to_piece(k).replace("▁", " ").encode(), -model.get_score(k))
        out = cls(ranks)
        worst = float(model.get_piece_size())
        weights = [1 / (min(ranks.get(p, worst), worst) + 2) for p in out.pieces] + [1 / (worst + 2)]
        return out, np.array(weights) / np.sum(weights)

    def edges(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, from, to, piece id) of every piece found in the rows of a byte matrix."""
        rows, length = block.shape
        power, inverse = (np.cumprod(np.full(length + 1, base, U), dtype=U) for base in (_BASE, _INVERSE))
        power, inverse = (np.concatenate((np.ones(1, U), x[:-1])) for x in (power, inverse))
        sums = np.zeros((rows, length + 1), U)
        np.cumsum((block.astype(U) + U(1)) * power[:-1], axis=1, dtype=U, out=sums[:, 1:])
        found = []
        for n in range(1, min(length, self.longest) + 1):
            key = mix((sums[:, n:] - sums[:, :-n]) * inverse[: length + 1 - n] + U(n * _INVERSE % (1 << 64)))
            row, start = np.nonzero(self.bloom[(key >> U(64 - _BLOOM)).astype(np.int64)])
            key = key[row, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            found.append((row[hit], start[hit], start[hit] + n, self.ids[at[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(words: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Indices of equally long words and their marked bytes as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        step = max(1, _BLOCK // (int(size) + 1))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            data = np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), size)
            yield part, np.concatenate((np.full((len(part), 1), 32, np.uint8), data), axis=1)


def _weights(vocabulary: Vocabulary, block: np.ndarray, p: np.ndarray):
    """Dense edge weights by (length - 1, start, row), and the edges."""
    row, start, stop, piece = vocabulary.edges(block)
    rows, length = block.shape
    dense = np.zeros((min(length, vocabulary.longest), length, rows))
    dense[stop - start - 1, start, row] = p[piece]
    return dense, (row, start, stop, piece)


def log_probabilities(vocabulary: Vocabulary, p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural logarithm of the sum over all segmentations, for every word, by the forward recursion.

    The sums run on scaled values with the logarithm of the scale kept beside them, so words of
    any length neither underflow nor lose precision.
    """
    out = np.zeros(len(words))
    for own, block in _blocks(words):
        rows, length = block.shape
        reach = min(length, vocabulary.longest)
        scale = np.zeros(rows)
        ahead = np.zeros((reach + 1, rows))  # sums at the next positions, already scaled
        now = np.ones(rows)
        # a very long word is read in strips, so that its edge weights stay small
        for lo in range(0, length, 4096):
            strip = block[:, lo : lo + 4096 + reach]
            dense, _ = _weights(vocabulary, strip, p)
            for start in range(min(4096, length - lo)):
                ahead[: len(dense)] += now * dense[:, start]
                now = ahead[0].copy()
                ahead[:-1] = ahead[1:]
                ahead[-1] = 0
                if start % 8 == 7:
                    top = np.maximum(now, ahead.max(axis=0))
                    scale += np.log(top)
                    now /= top
                    ahead /= top
        out[own] = np.log(now) + scale
    return out


def expected_counts(vocabulary: Vocabulary, p: np.ndarray, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations of the words, each word ``times`` times."""
    total = np.zeros(len(p))
    for own, block in _blocks(words):
        if block.shape[1] > SHORT + 1:
            total += _long_counts(vocabulary, p, block, times[own])
            continue
        rows, length = block.shape
        dense, (row, start, stop, piece) = _weights(vocabulary, block, p)
        reach = len(dense)
        forward, backward = np.zeros((length + 1, rows)), np.zeros((length + 1, rows))
        forward[0] = backward[length] = 1
        for i in range(length):
            n = min(reach, length - i)
            forward[i + 1 : i + n + 1] += forward[i] * dense[:n, i]
        for i in range(length - 1, -1, -1):
            n = min(reach, length - i)
            backward[i] = (dense[:n, i] * backward[i + 1 : i + n + 1]).sum(axis=0)
        # many rare bytes together: too small for plain sums
        thin = forward[length] < 1e-200
        if thin.any():
            total += _long_counts(vocabulary, p, block[thin], times[own][thin])
        share = np.divide(times[own], forward[length], out=np.zeros(rows), where=~thin)
        use = forward[start, row] * p[piece] * backward[stop, row] * share[row]
        total += np.bincount(piece, use, len(p))
    return total


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _long_counts(vocabulary: Vocabulary, p: np.ndarray, block: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``expected_counts`` of whole words of any length, in logarithms.

    The sums of all positions are kept, the edges of one strip of positions at a time.
    """
    rows, length = block.shape
    reach = min(length, vocabulary.longest)
    forward, backward = np.empty((length + 1, rows)), np.empty((length + 1, rows))
    forward[0] = backward[length] = 0
    total, log_p = np.zeros(len(p)), np.log(p)

    def logs(lo: int, hi: int):
        row, start, stop, piece = vocabulary.edges(block[:, lo:hi])
        dense = np.full((reach, hi - lo, rows), -np.inf)
        dense[stop - start - 1, start, row] = log_p[piece]
        return dense, row, start, stop, piece

    for lo in range(0, length, STRIP):
        hi, first = min(lo + STRIP, length), max(0, lo - reach)
        dense = logs(first, hi)[0]
        for at in range(lo + 1, hi + 1):
            back = np.arange(min(reach, at))
            forward[at] = _log_sum(forward[at - 1 - back] + dense[back, at - 1 - back - first])
    for lo in reversed(range(0, length, STRIP)):
        hi = min(lo + STRIP, length)
        dense, row, start, stop, piece = logs(lo, min(hi + reach, length))
        for at in range(hi - 1, lo - 1, -1):
            n = min(reach, length - at)
            backward[at] = _log_sum(dense[:n, at - lo] + backward[at + 1 : at + n + 1])
        own = start < hi - lo
        row, start, stop, piece = row[own], start[own] + lo, stop[own] + lo, piece[own]
        use = np.exp(forward[start, row] + log_p[piece] + backward[stop, row] - forward[length, row])
        total += np.bincount(piece, use * times[row], len(p))
    return total
