"""Operator 4: substring dedup by hashing lines, sentences or paragraphs.

Units are lines, the sentences of lines (a sentence ends with a word that ends in ``.``, ``!`` or
``?``, or with its line), or paragraphs between blank lines.  They are normalised (A-Z
lower-cased, white space collapsed) and digested to 128 bits.  Equal digests are grouped over the
whole corpus; the occurrence in the earliest ranked document, and there the first, stays.  Of the
others, those go that stand in a run of neighbouring repeated units of at least ``min_words``
words together; shorter runs repeat by chance and are left alone.  Offsets are code points of the
original text.

Half of a digest decides first which units occur twice at all, so what is sorted and joined is the
repeated units only, and one frequent unit costs a row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_IDS, written
from .lines import Lines, code_points, spans_hash
from .words import U, mix, texts

MIN_WORDS = 8

#: Digests (8 bytes) and groups (48 bytes) that are broadcast at most.
MAX_DIGESTS = 2_000_000
MAX_GROUPS = 50_000

_UNITS = "doc_id bigint, version bigint, d1 bigint, d2 bigint, at bigint, start bigint, end bigint, words bigint"
_REMOVED = "array<struct<start:bigint,end:bigint,words:bigint,kept_doc_id:bigint,kept_start:bigint>>"


def _paragraphs(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every run of lines that have words."""
    worded = np.flatnonzero(lines.words > 0)
    if not len(worded):
        return worded, worded
    new = np.ones(len(worded), bool)
    new[1:] = (worded[1:] != worded[:-1] + 1) | (lines.doc[worded][1:] != lines.doc[worded][:-1])
    heads = np.flatnonzero(new)
    return worded[heads], worded[np.concatenate((heads[1:], [len(worded)])) - 1]


def _limits(unit: str, lines: Lines) -> tuple[np.ndarray, ...]:
    """Document, first word, word after the last, first byte and byte after the last of every unit with words."""
    if unit == "sentence":
        part = lines.part
        closes = np.isin(part.data[part.ends - 1], np.frombuffer(b".!?", np.uint8)) if len(part.ends) else np.zeros(0, bool)
        worded = np.flatnonzero(lines.words > 0)
        closes[lines.word_hi[worded] - 1] = True
        last = np.flatnonzero(closes)
        first = np.concatenate(([0], last[:-1] + 1))[: len(last)]
        # sentences tile their line, white space and all
        line = worded[np.searchsorted(lines.word_lo[worded], first, "right") - 1] if len(first) else worded
        start = np.where(first == lines.word_lo[line], lines.starts[line], part.starts[first] if len(first) else first)
        after = np.append(part.starts, 0)[last + 1]
        end = np.where(last + 1 == lines.word_hi[line], lines.ends[line], after)
        return lines.doc[line], first, last + 1, start, end
    if unit == "paragraph":
        first, last = _paragraphs(lines)
    else:
        first = last = np.flatnonzero(lines.words > 0)
    return lines.doc[first], lines.word_lo[first], lines.word_hi[last], lines.starts[first], lines.ends[last]


def _units(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            for lo, _, part in texts(batch.column(2)):
                doc, low, high, start, end = _limits(unit, Lines(part))
                hashes = part.hashes()
                keys = [spans_hash(mix(hashes ^ U(s)), low, high).view(np.int64) for s in (1, 2)]
                points = code_points(part)
                base = points[part.limits[doc]]
                at = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(at),
                        versions.take(at),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        pa.array(np.arange(len(doc)) - np.searchsorted(doc, doc)),
                        pa.array(points[start] - base),
                        pa.array(points[end] - base),
                        pa.array((high - low).astype(np.int64)),
                    ],
                    names=["doc_id", "version", "d1", "d2", "at", "start", "end", "words"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if spans and text is not None:
                kept, at = [], 0
                for span in spans:
                    if span["start"] > at:
                        kept.append(text[at : span["start"]])
                    at = span["end"]
                    # a line of which nothing is left goes with its end
                    if text[at : at + 1] == "\n" and (not kept or kept[-1].endswith("\n")):
                        at += 1
                text = "".join([*kept, text[at:]])
            out.append(text)
        columns = [batch.column(0), pa.array(out, pa.string()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "clean_text", *batch.schema.names[2:]])


def _sized(df: DataFrame, most: int) -> DataFrame:
    """For a join: a written table, broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def _versions(docs: DataFrame) -> DataFrame:
    """``docs`` with a version that tells rows of one id apart: the text's hash where the id repeats.

    Elsewhere it is 0: a hash in every unit's row would be a third of what is shuffled.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    ids = written(ids.select("doc_id", F.lit(True).alias("again")), "repeated_ids")
    found = ids.count()
    if found > MAX_IDS:
        return docs.withColumn("version", F.xxhash64("text"))
    version = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.join(F.broadcast(ids), "doc_id", "left").withColumn("version", version).drop("again")


def _with_removed(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with their removed spans, null where there are none.

    Up to ``MAX_IDS`` ids of documents that lose something are broadcast, so that no other text moves.
    """
    ids = written(removed.select("doc_id").distinct(), "removed_ids")
    key = ["doc_id", "version"]
    if ids.count() > MAX_IDS:
        return docs.join(removed.hint("merge"), key, "left")
    cut = docs.join(F.broadcast(ids), "doc_id", "left_semi").join(removed.hint("merge"), key, "left")
    whole = docs.join(F.broadcast(ids), "doc_id", "left_anti").withColumn("removed", F.lit(None).cast(_REMOVED))
    return cut.unionByName(whole)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    unit: str = "line",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, clean_text and removed of every row: the removed spans by start, each with its
    number of words and the place of the occurrence that stays.

    ``id_col`` is the rank.  Null text: nothing to remove, clean_text null.  A row with a null
    id is left alone and keeps no unit from others.  Rows that repeat both id and text are one
    document and come out alike; other rows of one id are ranked by their text's hash.  Other
    columns are ignored, whatever their names.  Empty input: empty result.
    """
    if unit not in ("line", "sentence", "paragraph"):
        raise ValueError(f"unit must be line, sentence or paragraph, not {unit!r}")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = _versions(docs)
    named = docs.where("doc_id is not null and text is not null").select("doc_id", "version", "text")
    units = written(named.mapInArrow(_units(unit), _UNITS), "units")
    twice = written(units.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "twice")
    repeated = written(units.join(_sized(twice, MAX_DIGESTS), "d1"), "repeated")
    place = F.struct("doc_id", "version", "start")
    groups = repeated.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    groups = written(groups.where("first <> last").select("d1", "d2", "first"), "groups")
    extra = repeated.join(_sized(groups, MAX_GROUPS), ["d1", "d2"]).where(place != F.col("first"))
    stays = [F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")]
    # dealt by document once: the distinct rows, the windows and the join below need no other deal
    extra = extra.select("doc_id", "version", "at", "start", "end", "words", *stays).repartition("doc_id", "version").distinct()
    # neighbours have the same distance to their number within the document
    document = Window.partitionBy("doc_id", "version")
    extra = extra.withColumn("run", F.col("at") - F.row_number().over(document.orderBy("at")))
    extra = extra.withColumn("together", F.sum("words").over(Window.partitionBy("doc_id", "version", "run")))
    extra = extra.where(F.col("together") >= min_words)
    span = F.struct("start", "end", "words", "kept_doc_id", "kept_start")
    removed = extra.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(span)).alias("removed"))
    out = _with_removed(docs, written(removed, "removed")).select(
        "doc_id", "text", F.coalesce("removed", F.array().cast(_REMOVED)).alias("removed")
    )
    return out.mapInArrow(_cut, f"doc_id bigint, clean_text string, removed {_REMOVED}")
