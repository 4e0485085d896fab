"""Operator 8: quality rules, cross-document line frequency.

Every line is normalised (A-Z lower-cased, white space collapsed) and hashed; per host,
the distinct documents that hold it are counted, where copies of one text count once.
A line found in more than ``min_documents`` documents and more than ``max_share`` of the
host's documents is boilerplate there and is removed; a document that keeps less than
``min_left`` of its words is depleted and rejected.

The limits differ: ``max_share`` follows the host's size, ``min_documents`` does not.  So a host
of ``min_documents`` distinct texts or fewer has no boilerplate at all, and in a very large host
a line stays, in however many documents, up to ``max_share`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .lines import Lines, spans_hash
from .words import U, mix, texts

MIN_DOCUMENTS = 10
MAX_SHARE = 0.05
MIN_LEFT = 0.3
WINDOW = 8
#: Boilerplate lines that are broadcast at most (24 bytes each); beyond, a shuffled join.
MAX_BROADCAST = 200_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_LINE = "array<struct<line:bigint,words:bigint,places:array<int>>>"
_ROW = (
    "doc_id bigint, host string, digest bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
    f"n_dup_lines bigint, n_repeat_words bigint, lines {_LINE}"
)


def _within(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (doc, key), and whether each in that order equals the one before."""
    order = np.lexsort((key, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    return order, same


def _per_text(part, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[part.limits[1:]] - sums[part.limits[:-1]]


def _repeat_words(part) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in it."""
    exact = spans_hash(part.data.astype(U) + U(1), part.starts, part.ends)
    windows, at = part.window_hashes(exact, WINDOW)
    key = mix(windows + part.doc[at].astype(U) * U(0x9E3779B97F4A7C15))  # a window of one text
    order = np.argsort(key)
    twice = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    twice[1:] |= same
    twice[:-1] |= same
    found = at[order[twice]]
    steps = np.zeros(len(part.starts) + 1, np.int64)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + WINDOW, -1)
    return np.bincount(part.doc[np.cumsum(steps)[:-1] > 0], minlength=part.n)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, part in texts(batch.column(2)):
            lines = Lines(part)
            worded = lines.words > 0
            doc, raw = lines.doc[worded], lines.raw()[worded]
            order, same = _within(doc, raw)
            duplicates = np.bincount(doc[order[same]], minlength=part.n)
            key, words, place = lines.normalised()[worded], lines.words[worded], lines.ordinal[worded]
            order, same = _within(doc, key)
            heads = np.flatnonzero(~same)
            totals = np.add.reduceat(words[order], heads) if len(heads) else np.zeros(0, np.int64)
            inner = np.concatenate((heads, [len(order)])).astype(np.int32)
            outer = np.concatenate(([0], np.cumsum(np.bincount(doc[order[heads]], minlength=part.n)))).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(inner), pa.array(place[order].astype(np.int32)))
            entry = pa.StructArray.from_arrays(
                [pa.array(key[order[heads]].view(np.int64)), pa.array(totals.astype(np.int64)), places],
                names=["line", "words", "places"],
            )
            digest = mix(spans_hash(part.data.astype(U) + U(1), part.limits[:-1], part.limits[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    pa.array(digest.view(np.int64)),
                    pa.array(part.counts.astype(np.int64)),
                    pa.array(_per_text(part, part.is_word & ((part.data & 0xC0) != 0x80)).astype(np.int64)),
                    pa.array(_per_text(part, _SYMBOL[part.data]).astype(np.int64)),
                    pa.array(duplicates.astype(np.int64)),
                    pa.array(_repeat_words(part).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(outer), entry),
                ],
                names=["doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    *,
    min_documents: int = MIN_DOCUMENTS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Counts, the numbers of the removed lines (from 0, ascending) and the verdict of every row.

    Null text counts as empty: no words, base_failed, not kept.  Null hosts are one host;
    a null id is returned as it is.  Repeated rows count as one document and each gets its
    verdict.  Other columns are ignored, whatever their names.  Empty input: empty result.
    ``clean_text`` applies the removal.
    """
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")
    )
    rows = docs.mapInArrow(_scan, _ROW).withColumn("host", F.coalesce("host", F.lit(""))).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "rows")
    totals = rows.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    lines = rows.select("row", "host", "digest", F.explode("lines").alias("l")).select("row", "host", "digest", "l.line", "l.words", "l.places")
    seen = lines.select("host", "line", "digest").distinct().groupBy("host", "line").agg(F.count("*").alias("found"))
    common = seen.where(F.col("found") > min_documents).join(totals, "host").where(F.col("found") > max_share * F.col("documents"))
    common = written(common.select("host", "line"), "common")
    common = F.broadcast(common) if common.count() <= MAX_BROADCAST else common.hint("merge")
    removed = lines.join(common, ["host", "line"]).groupBy("row")
    removed = removed.agg(F.sum("words").alias("lost"), F.sort_array(F.flatten(F.collect_list("places"))).alias("removed_lines"))
    out = rows.drop("lines").join(removed, "row", "left")
    lost = F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - lost >= min_left * F.col("n_words"))).alias("kept"),
        lost.cast("long").alias("n_removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def clean_text(text: Column, removed_lines: Column) -> Column:
    """``text`` without the lines of the given numbers."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(removed_lines, i)), "\n")
