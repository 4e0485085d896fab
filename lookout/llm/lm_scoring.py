"""Operator 5: language-model scoring by subword lattice likelihood.

The piece vocabulary exists and is not changed; its scores give the first weights, and a few
rounds of expectation-maximisation over the training words (every distinct word with its count)
give the unigram probabilities.  A text's score is the log10 of its marginal probability: the
sum over all segmentations of all its words, by the forward recursion in log space, times that
of the end piece.

Word counts are summed over the cluster.  Only the most frequent words (at most ``HEAD_WORDS``,
a fixed bound) are broadcast; all others meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .lattice import Vocabulary, expected_counts, log_probabilities

HEAD_WORDS = 1 << 18
#: Longer words are never broadcast.
HEAD_BYTES = 64
ROUNDS = 2
#: Added to every piece's expected count, so that none is impossible.
SMOOTHING = 0.1
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
    "rest array<struct<word:binary,times:int>>"
)


def words_of(text: str | None) -> list[bytes]:
    """Words between space and 0x09-0x0D, A-Z lower-cased, as UTF-8 (what bytes.split() does)."""
    return text.encode().translate(_LOWER).split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "c"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    yield out()


def _expect(vocabulary: Vocabulary, p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(p))
        for batch in batches:
            total += expected_counts(vocabulary, p, batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p))), pa.array(total)], names=["piece", "uses"])

    return run


def _word_scores(vocabulary: Vocabulary, p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = log_probabilities(vocabulary, p, batch.column(0).to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=["word", "c", "score"])

    return run


def _score(vocabulary: Vocabulary, p: np.ndarray, head, end_base: float, end_known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base_of, score_of = head.value
        place = dict(zip(words, range(len(words)), strict=True))
        end = float(np.log10(p[vocabulary.end]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield _rows(part, place, base_of, score_of, vocabulary, p, end, end_base, end_known)

    return run


def _rows(part, place, base_of, score_of, vocabulary, p, end, end_base, end_known) -> pa.RecordBatch:
    n_tokens, known, base, score, rest = [], [], [], [], []
    for text in part.column(2):
        words = words_of(text.as_py())
        at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
        hit = at[at >= 0]
        n_tokens.append(len(words) + 1)
        known.append(len(hit) + end_known)
        base.append(float(base_of[hit].sum()) + end_base)
        score.append(float(score_of[hit].sum()) + end)
        rest.append(Counter(words[k] for k in np.flatnonzero(at < 0)))
    new = list(dict.fromkeys(w for counts in rest for w in counts))
    value = dict(zip(new, log_probabilities(vocabulary, p, new) / np.log(10), strict=True))
    for k, counts in enumerate(rest):
        score[k] += sum(value[w] * c for w, c in counts.items())
    limits = np.concatenate(([0], np.cumsum([len(x) for x in rest]))).astype(np.int32)
    pairs = pa.StructArray.from_arrays(
        [pa.array([w for x in rest for w in x], pa.binary()), pa.array([c for x in rest for c in x.values()], pa.int32())],
        names=["word", "times"],
    )
    columns = [part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64())]
    columns += [pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(limits), pairs)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"])


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words: whole levels of the count from the top, at most ``most`` words."""
    short = counts.where(F.length("word") <= HEAD_BYTES)
    level = F.floor(F.log2("c") * 8).cast("int")
    # at most a few hundred levels
    levels = sorted(((r["level"], r["n"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, total = None, 0
    for at, n in levels:
        total += n
        if total > most:
            break
        lowest = at
    return short.where(level >= lowest) if lowest is not None else short.limit(0)


def lattice_scores(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    rounds: int = ROUNDS,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A row is held out when crc32 of its id as text leaves 2 on division by 7; a null id counts
    as empty text.  Null or wordless text has the end token alone.  Repeated rows train and are
    scored one by one.  Other columns are ignored, whatever their names.  With no training row,
    nothing is known and the pieces keep their first weights.  Empty input: empty result.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = docs.where("not held_out")
    counts = training.select("text").mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = written(counts, "counts")
    ends = training.count()
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = seen[0] + ends, seen[1] + (ends > 0)

    vocabulary, p = Vocabulary.from_sentencepiece(vocabulary_path)
    for _ in range(rounds if tokens else 0):
        uses = np.zeros(len(p))
        # as many rows as the vocabulary has pieces
        for r in counts.mapInArrow(_expect(vocabulary, p), "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] = r["uses"]
        uses[vocabulary.end] += ends
        p = (uses + SMOOTHING) / (uses.sum() + SMOOTHING * len(p))

    frequent = _head(counts, head_words).mapInArrow(_word_scores(vocabulary, p), "word binary, c bigint, score double").toArrow()
    base = np.log10(frequent["c"].to_numpy() + 1.0)
    head = spark.sparkContext.broadcast((frequent["word"].to_pylist(), base, frequent["score"].to_numpy()))
    scored = docs.mapInArrow(_score(vocabulary, p, head, float(np.log10(ends + 1)), int(ends > 0)), _SCORED)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.times").join(counts, "word")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rest_base"), F.sum("times").alias("rest_known")
    )
    out = scored.drop("rest").join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        "score",
    )
