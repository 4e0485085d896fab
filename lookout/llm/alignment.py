"""Operator 12: how the tokens of two tokenizers correspond.

Both tokenizers cover the same bytes.  For a batch of documents the tokens of each side get byte
offsets; ``pandas.merge_asof``, keyed by document, finds for every token's start the other side's
token that covers it, in both directions.  The union of the two is every overlap.  Overlaps whose
tokens end at the same byte cut the document into groups, the smallest stretches that both sides
tile; a link is a pair of tokens, one of each side, of one group.

How many documents hold a pair of ids linked is counted over the whole corpus: tasks write every
document's pairs once, Spark counts them, and a second pass looks them up.  The ``HEAD`` most
frequent pairs (a fixed bound) are broadcast, all others are joined.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .word_ids import shown_bytes
from .words import released

#: Pairs that are broadcast at most (16 bytes each).
HEAD = 1 << 18
#: Characters of text that are aligned at once; a longer text is aligned alone.
CHUNK = 1 << 20

_ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<int>"
)
_SCORED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, key bigint, "
    "n_best bigint, count_sum bigint, rare array<bigint>, rare_times array<int>"
)


class ByteLevel:
    """Side A: a byte-level tokenizer, given as its file and as the same vocabulary's ranks.

    Ids come from ``tiktoken``, which merges by rank, much the faster of the two; a text that its
    pattern matcher gives up on goes to the file's own library.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(ranks, "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        byte, size = shown_bytes(), self.own.get_vocab_size()
        self.bytes = [b""] * size
        for shown, k in self.own.get_vocab(with_added_tokens=False).items():
            self.bytes[k] = bytes(byte[c] for c in shown) if all(c in byte for c in shown) else shown.encode()
        if any(self.bytes[k] != own for own, k in merges.items()):
            raise ValueError(f"{ranks} does not hold the vocabulary of {path}")

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(" " + text)
        except (ValueError, RuntimeError):
            return self.own.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """Side B: a piece vocabulary with byte fallback, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.bytes = [self._bytes(p) for p in pieces]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """The tokens of a batch on one side, one document after another."""

    def __init__(self, ids: list[list[int]], lengths: np.ndarray):
        self.ids = np.frombuffer(array("i", chain.from_iterable(ids)), np.int32).astype(np.int64)
        self.count = np.array([len(x) for x in ids], np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.count)
        own = lengths[self.ids]
        self.end = np.cumsum(own)
        self.start = self.end - own

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"start": self.start, "doc": self.doc, name: np.arange(len(self.ids))})


def covering(of: Side, by: Side) -> np.ndarray:
    """For each token of one side, the other side's token that covers its first byte."""
    found = pd.merge_asof(of.frame("own"), by.frame("other"), on="start", by="doc")
    return found["other"].to_numpy(np.int64)


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that share a byte, as two arrays of positions in the batch."""
    over_a, over_b = covering(a, b), covering(b, a)
    more = a.start[over_a_of := over_b] != b.start  # where both start together, the first direction has the pair
    return (
        np.concatenate([np.arange(len(a.ids)), over_a_of[more]]),
        np.concatenate([over_a, np.flatnonzero(more)]),
    )


class Batch:
    """The aligned tokens of some documents: ``group_a`` and ``group_b`` number the groups."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        one, other = overlaps(a, b)
        closing = a.end[one] == b.end[other]
        self.last_a, self.last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
        self.last_a[one[closing]] = True
        self.last_b[other[closing]] = True
        self.group_a = np.cumsum(self.last_a) - self.last_a
        self.group_b = np.cumsum(self.last_b) - self.last_b
        self.in_a, self.in_b = np.bincount(self.group_a), np.bincount(self.group_b)
        self.group_doc = a.doc[self.last_a]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the two tokens of every link."""
        each = self.in_b[self.group_a] if len(self.a.ids) else np.zeros(0, np.int64)
        one = np.repeat(np.arange(len(self.a.ids)), each)
        first = np.cumsum(self.in_b) - self.in_b
        within = np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each)
        return one, first[self.group_a[one]] + within

    def spelled(self, shown: list[str], size_a: int, size_b: int) -> list[str]:
        """Every document's groups as text: ids of A, bar, ids of B; groups parted by semicolons."""
        before = np.cumsum(self.in_b) - self.in_b
        through = np.cumsum(self.in_a)
        codes = np.empty(len(self.a.ids) + len(self.b.ids), np.int64)
        codes[np.arange(len(self.a.ids)) + before[self.group_a]] = self.a.ids + size_a * self.last_a
        codes[np.arange(len(self.b.ids)) + through[self.group_b]] = 2 * size_a + self.b.ids + size_b * self.last_b
        codes, out, at = codes.tolist(), [], 0
        for n in (self.a.count + self.b.count).tolist():
            out.append("".join(map(shown.__getitem__, codes[at : at + n]))[:-1])
            at += n
        return out


class Aligner:
    """Both tokenizers and what they need in a Python worker."""

    def __init__(self, path_a: str, ranks_a: str, pattern_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a, ranks_a, pattern_a), Pieces(path_b)
        self.length_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.length_b = np.array([len(x) for x in self.b.bytes], np.int64)
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        self.shown = [f"{k}{end}" for size, ends in ((size_a, ",|"), (size_b, ",;")) for end in ends for k in range(size)]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where a text is null or empty, or a side's bytes are not the text's."""
        given = [k for k, t in enumerate(texts) if t]
        ids_a: list[list[int]] = [[] for _ in texts]
        ids_b: list[list[int]] = [[] for _ in texts]
        for k, b in zip(given, self.b.encode_all([texts[k] for k in given]), strict=True):
            a, whole = self.a.encode(texts[k]), b" " + texts[k].encode()
            if self._joined(self.a.bytes, a) == whole == self._joined(self.b.bytes, b):
                ids_a[k], ids_b[k] = a, b
        return ids_a, ids_b

    @staticmethod
    def _joined(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(table.__getitem__, ids))

    def align(self, texts: list[str | None]) -> Batch:
        ids_a, ids_b = self.tokens(texts)
        return Batch(Side(ids_a, self.length_a), Side(ids_b, self.length_b))


@lru_cache(1)
def _aligner(*paths: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(*paths)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > CHUNK:
            yield begin, k
            begin, size = k, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def _aligned(paths: tuple[str, ...], docs: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    tools = _aligner(*paths)
    batch, n = tools.align(texts), len(texts)
    size_a, size_b = len(tools.a.bytes), len(tools.b.bytes)
    one, other = batch.links()
    key = (batch.a.doc[one] * size_a + batch.a.ids[one]) * size_b + batch.b.ids[other]
    held, times = np.unique(key, return_counts=True)
    of = held // (size_a * size_b)
    offsets = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
    shown = batch.spelled(tools.shown, size_a, size_b)
    columns = [
        pa.array(docs, pa.int64()),
        pa.array(batch.a.count),
        pa.array(batch.b.count),
        pa.array(np.bincount(batch.group_doc, minlength=n)),
        pa.array(np.bincount(batch.a.doc[one], minlength=n)),
        pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]),
        pa.ListArray.from_arrays(offsets, pa.array(held % (size_a * size_b))),
        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
    ]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _align(paths: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in _chunks(texts):
                yield _aligned(paths, docs[low:high], texts[low:high])

    return run


def _scores(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = head.value
        for batch in batches:
            names = batch.schema.names
            lists, many = batch.column(names.index("pairs")), batch.column(names.index("times"))
            held, times = lists.flatten().to_numpy(), many.flatten().to_numpy().astype(np.int64)
            n = len(batch)
            size = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(n), size)
            at = np.minimum(np.searchsorted(pairs, held), max(len(pairs) - 1, 0))
            known = pairs[at] == held if len(pairs) else np.zeros(len(held), bool)
            at, own = at[known], times[known]
            rare = np.searchsorted(of[~known], np.arange(n + 1)).astype(np.int32)

            def summed(values):
                total = np.zeros(n, np.int64)
                np.add.at(total, of[known], values)
                return pa.array(total)

            columns = [batch.column(k) for k, name in enumerate(names) if name not in ("pairs", "times")]
            columns += [
                summed(own * best[at]),
                summed(own * counts[at]),
                pa.ListArray.from_arrays(pa.array(rare), pa.array(held[~known])),
                pa.ListArray.from_arrays(pa.array(rare), pa.array(times[~known].astype(np.int32))),
            ]
            kept = [x for x in names if x not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum", "rare", "rare_times"])

    return run


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, n, best): how many documents hold a pair, and whether none of its A id's pairs is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    # one row an id of A's vocabulary at most
    return written(counts.join(F.broadcast(most), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align_tokens(
    docs: DataFrame,
    path_a: str,
    ranks_a: str,
    pattern_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    head: int = HEAD,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A encodes a space and the text, side B the text, to which it adds the space itself.
    ``n_best`` counts the links whose pair is held by as many documents as any pair of its A id;
    ``count_sum`` adds up those numbers over all links.  A null or empty text, and one that either
    side does not give back byte by byte, has no tokens: zeros and ``''``.  Repeated rows and null
    ids are documents like any.  A very long text is aligned alone.  Other columns are ignored,
    whatever their names.  Empty input: empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = docs.mapInArrow(released(_align((path_a, ranks_a, pattern_a, path_b))), _ALIGNED)
    aligned = written(aligned.withColumn("key", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(aligned, len(Pieces(path_b).bytes))
    scored = written(_scored(spark, aligned, counts, head), "scored")
    rare = scored.select("key", F.explode(F.arrays_zip("rare", "rare_times")).alias("r"))
    rare = rare.select("key", F.col("r.rare").alias("pair"), F.col("r.rare_times").cast("long").alias("times"))
    looked = rare.join(counts.hint("merge"), "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    plain, mixed = scored.where(F.size("rare") == 0), scored.where(F.size("rare") > 0)
    mixed = mixed.join(looked.hint("merge"), "key").withColumns(
        {"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")}
    )
    return plain.select(*columns, "n_best", "count_sum", "groups_sha256").unionByName(
        mixed.select(*columns, "n_best", "count_sum", "groups_sha256")
    )


def _scored(spark: SparkSession, aligned: DataFrame, counts: DataFrame, head: int) -> DataFrame:
    first = counts.orderBy(F.desc("n"), "pair").limit(head).select("pair", "n", "best").toArrow()  # at most ``head`` rows
    order = np.argsort(first["pair"].to_numpy())
    table = tuple(
        first[c].to_numpy(zero_copy_only=False)[order].astype(np.int64) if len(order) else np.zeros(0, np.int64)
        for c in ("pair", "n", "best")
    )
    known = spark.sparkContext.broadcast(table)
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "key", "pairs", "times"
    ).mapInArrow(_scores(known), _SCORED)
