import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lookout.llm import lattice
from lookout.llm.lattice import Vocabulary, expected_counts, log_probabilities
from lookout.llm.lm_scoring import lattice_scores
from lookout.llm.registry import tokenizer_path

from . import brute

PATH = tokenizer_path("piece_bpe_32k.model")


def _paths(word, pieces):
    """All segmentations of a word, as lists of pieces."""
    if not word:
        return [[]]
    return [[p, *rest] for k in range(1, len(word) + 1) if (p := word[:k]) in pieces for rest in _paths(word[k:], pieces)]


def test_forward_sum_and_counts_are_over_all_segmentations():
    vocabulary = Vocabulary([b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"bab", b"c d", "é".encode()])
    rng = np.random.default_rng(1)
    p = rng.random(len(vocabulary.pieces) + 1)
    p /= p.sum()
    pid = {x: k for k, x in enumerate(vocabulary.pieces)}
    words = [b"a", b"abab", b"babab", "éa".encode(), b"\xff\x00z", b"ab" * 4]
    want, counts = [], np.zeros(len(p))
    times = np.arange(1.0, len(words) + 1)
    for word, n in zip(words, times, strict=True):
        paths = _paths(b" " + word, pid)
        weights = [math.prod(p[pid[x]] for x in path) for path in paths]
        want.append(math.log(sum(weights)))
        for path, w in zip(paths, weights, strict=True):
            for x in path:
                counts[pid[x]] += n * w / sum(weights)
    assert np.allclose(log_probabilities(vocabulary, p, words), want)
    assert np.allclose(expected_counts(vocabulary, p, words, times), counts)
    long = log_probabilities(vocabulary, p, [b"x" * 20_000, b"x" * 10_000])
    assert np.isfinite(long).all() and abs(long[0] / long[1] - 2) < 0.01


def _exact_counts(word, p, pid):
    """Expected uses of every piece in one word, by exact fractions."""
    data, longest = b" " + word, max(map(len, pid))
    forward, backward = [Fraction(1)] + [Fraction(0)] * len(data), [Fraction(0)] * len(data) + [Fraction(1)]
    edges = [(i, j, pid[data[i:j]]) for i in range(len(data)) for j in range(i + 1, min(len(data), i + longest) + 1) if data[i:j] in pid]
    for i, j, k in edges:
        forward[j] += forward[i] * Fraction(p[k])
    for i, j, k in reversed(edges):
        backward[i] += Fraction(p[k]) * backward[j]
    out = np.zeros(len(p))
    for i, j, k in edges:
        out[k] += float(forward[i] * Fraction(p[k]) * backward[j] / forward[-1])
    return out


@pytest.mark.parametrize("strip", [7, 64, 4096])
def test_counts_of_long_and_of_improbable_words_are_whole(monkeypatch, strip):
    monkeypatch.setattr(lattice, "STRIP", strip)
    vocabulary = Vocabulary([b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"bab", b"abababababab"])
    rng = np.random.default_rng(2)
    p = rng.random(len(vocabulary.pieces) + 1)
    pid = {x: k for k, x in enumerate(vocabulary.pieces)}
    p[[pid[bytes([c])] for c in range(128, 256)]] = 1e-9
    p /= p.sum()
    words = [b"ab" * 21, b"a" * 40, b"ba" * 70 + b"x", bytes(range(128, 168)), bytes(range(160, 250)) * 2, b"ab", b"abb"]
    times = np.arange(1.0, len(words) + 1)
    want = sum(n * _exact_counts(w, p, pid) for w, n in zip(words, times, strict=True))
    got = expected_counts(vocabulary, p, words, times)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-9)
    # every byte of every word is in exactly one piece
    spelled = sum(k * len(x) for k, x in zip(got, vocabulary.pieces))
    assert math.isclose(spelled, sum(n * (len(w) + 1) for w, n in zip(words, times)), rel_tol=1e-9)


def test_counts_of_a_very_long_word():
    vocabulary = Vocabulary([b" x", b"x", b"xx", b"xxxxxxx"])
    p = np.full(len(vocabulary.pieces) + 1, 1e-3)
    got = expected_counts(vocabulary, p, [b"x" * 30_000], np.ones(1))
    assert math.isclose(sum(k * len(x) for k, x in zip(got, vocabulary.pieces)), 30_001, rel_tol=1e-6)


def test_base_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(10**6)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter()
    for d, t in rows:
        if not held[d]:
            counts.update([*map(brute.lower, brute.words(t)), "\n"])
    n, v = sum(counts.values()), len(counts)
    for head in (1 << 18, 50):  # all words broadcast, or nearly all joined
        got = {r.doc_id: r for r in lattice_scores(docs, PATH, rounds=1, head_words=head).collect()}
        for d, t in rows:
            tokens = [*map(brute.lower, brute.words(t)), "\n"]
            r = got[d]
            base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
            assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(tokens), n)
            assert r.n_known == sum(counts[x] > 0 for x in tokens)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_training_raises_held_out_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = [lattice_scores(docs, PATH, rounds=k).where("held_out").agg({"score": "sum"}).first()[0] for k in (0, 2)]
    assert total[1] > total[0]
