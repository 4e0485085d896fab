"""Operator 4, second half: passages that repeat anywhere, wherever lines break.

A passage is a run of ``min_words`` normalised words (A-Z lower-cased, white space collapsed),
across line breaks.  Every such run that occurs earlier in the corpus, in an earlier ranked
document or at least ``min_words`` words before in the same one, is removed; runs that overlap
merge, so a repeated passage goes whole, up to the words where it begins to differ.

All runs of all texts would be a row per word.  Hence a sieve that misses nothing: every run
holds as many word windows of half its length as fit, the least hash of these speaks for the run
(winnowing), equal runs have equal speakers, and only runs whose speaker occurs in two places
are digested to 128 bits and compared.  Texts that repeat whole, as normalised words, are found
by one digest each before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_IDS, written
from .line_dedup import _REMOVED
from .lines import code_points, spans_hash
from .words import Texts, U, mix, texts

MIN_RUN = 50


def _speakers(part: Texts, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every run of ``size`` words of one text, its speaker's place and hash."""
    short = size // 2 + 1
    wide = size - short + 1
    starts = np.arange(max(0, len(hashes) - short + 1))
    grams = spans_hash(hashes, starts, starts + short)
    if len(hashes) < size:
        return starts[:0], starts[:0], grams[:0]
    places = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(hashes) - size + 1)
    runs = np.flatnonzero(part.doc[: len(places)] == part.doc[size - 1 :])
    return runs, places[runs], grams[places[runs]]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, number of words and limits of the words of every text that has words."""
    for batch in batches:
        for lo, _, part in texts(batch.column(2)):
            hashes, points, at = part.hashes(), code_points(part), np.flatnonzero(part.counts)
            first, last, base = part.first[at], part.first[at + 1], points[part.limits[at]]
            keys = [spans_hash(mix(hashes ^ U(s)), first, last).view(np.int64) for s in (1, 2)]
            limits = [points[part.starts[first]] - base, points[part.ends[last - 1]] - base]
            rows = pa.array(lo + at)
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, [*keys, *limits, part.counts[at]])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "d1", "d2", "start", "end", "words"])


def _sieve(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, part in texts(batch.column(2)):
                _, places, hashes = _speakers(part, part.hashes(), size)
                places, first = np.unique(places, return_index=True)
                at = pa.array(lo + part.doc[places])
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[first].view(np.int64))]
                places = (places - part.first[part.doc[places]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(places)], names=["doc_id", "version", "speaker", "at"])

    return run


def _runs(size: int):
    """A row for every marked speaker: its runs' first word, digests (two numbers a run) and limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(3)
            for lo, hi, part in texts(batch.column(2)):
                hashes = part.hashes()
                runs, places, names = _speakers(part, hashes, size)
                own = marks.slice(lo, hi - lo)
                marked = own.flatten().to_numpy(zero_copy_only=False) + np.repeat(part.first[:-1], own.value_lengths().to_numpy(zero_copy_only=False))
                chosen = np.isin(places, marked)
                runs, places, names = runs[chosen], places[chosen], names[chosen]
                # the runs of one speaker follow each other
                _, heads = np.unique(places, return_index=True)
                bounds = np.append(heads, len(runs)).astype(np.int32)
                digests = np.stack([spans_hash(mix(hashes ^ U(s)), runs, runs + size) for s in (1, 2)], axis=1).view(np.int64).ravel()
                points, doc = code_points(part), part.doc[runs]
                base = points[part.limits[doc]]
                limits = [(points[x] - base).astype(np.int32) for x in (part.starts[runs], part.ends[runs + size - 1])]
                at = pa.array(lo + doc[heads])
                columns = [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(names[heads].view(np.int64)),
                    pa.array((runs - part.first[doc])[heads]),
                    pa.ListArray.from_arrays(pa.array(bounds * 2), pa.array(digests)),
                    *(pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in limits),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "speaker", "word", "digests", "starts", "ends"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans; a line break after a span goes with it if the span begins a line."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if spans and text is not None:
                kept, at = [], 0
                for span in spans:
                    start, end = span["start"], span["end"]
                    kept.append(text[at:start])
                    at = end + (text[end : end + 1] == "\n" and text[max(start - 1, 0) : start] in ("", "\n"))
                text = "".join([*kept, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], names=["doc_id", "clean_text", "removed"])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.withColumn("version", F.xxhash64("text"))


def _met(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with rows of a written table; up to ``MAX_IDS`` are broadcast, so texts do not move."""
    return docs.join(F.broadcast(keys) if keys.count() <= MAX_IDS else keys.hint("merge"), ["doc_id", "version"], how)


def _spans(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, version, start, end, words, kept_doc_id, kept_start) of every passage to remove."""
    named = docs.where("doc_id is not null and text is not null").select("doc_id", "version", "text")

    # whole copies go by one digest a text, so their runs need none
    schema = "doc_id bigint, version bigint, d1 bigint, d2 bigint, start bigint, end bigint, words bigint"
    whole = written(named.mapInArrow(_whole, schema), "texts")
    place = F.struct("doc_id", "version", "start")
    groups = whole.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    copies = whole.where(F.col("words") >= size).join(groups.select("d1", "d2", "first"), ["d1", "d2"]).where(place != F.col("first"))
    stays = [F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")]
    copies = written(copies.select("doc_id", "version", "start", "end", "words", *stays).distinct(), "copies")
    named = _met(named, copies.select("doc_id", "version"), "left_anti")

    speakers = named.mapInArrow(_sieve(size), "doc_id bigint, version bigint, speaker bigint, at int")
    speakers = speakers.withColumn("found", F.count("*").over(Window.partitionBy("speaker"))).where("found > 1")
    marks = written(speakers.groupBy("doc_id", "version").agg(F.collect_set("at").alias("marks")), "marks")
    found = _met(named, marks.select("doc_id", "version"), "left_semi").join(marks, ["doc_id", "version"])
    schema = "doc_id bigint, version bigint, speaker bigint, word bigint, digests array<bigint>, starts array<int>, ends array<int>"
    rows = found.select("doc_id", "version", "text", "marks").mapInArrow(_runs(size), schema)
    # equal runs have equal speakers: dealt once, by speaker, before the digests are laid out
    rows = rows.repartition("speaker").select("*", F.posexplode("starts").alias("k", "start"))
    runs = rows.select(
        "doc_id",
        "version",
        "speaker",
        F.col("word").alias("head"),
        (F.col("word") + F.col("k")).alias("word"),
        F.expr("digests[2 * k]").alias("d1"),
        F.expr("digests[2 * k + 1]").alias("d2"),
        F.col("start").cast("long").alias("start"),
        F.expr("ends[k]").cast("long").alias("end"),
    )
    runs = runs.withColumn("first", F.min(F.struct("doc_id", "version", "word", "start")).over(Window.partitionBy("speaker", "d1", "d2")))
    # the run that stays keeps its words: one that overlaps it is no repeat of its own
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    extra = runs.where(~same | (F.col("word") >= F.col("first.word") + size))
    # runs of one speaker overlap, so they make one piece
    pieces = extra.groupBy("speaker", "doc_id", "version", "head").agg(
        F.min("word").alias("low"), F.max("word").alias("high"), F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("word", "first")).alias("top")
    )
    within = Window.partitionBy("doc_id", "version").orderBy("low")
    pieces = pieces.withColumn("new", F.coalesce(F.col("low") > F.lag("high").over(within) + size, F.lit(True)).cast("long"))
    pieces = pieces.withColumn("passage", F.sum("new").over(within))
    spans = pieces.groupBy("doc_id", "version", "passage").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max("high") - F.min("low") + size).cast("long").alias("words"),
        F.min("top").alias("top"),
    )
    columns = ["doc_id", "version", "start", "end", "words"]
    spans = spans.select(*columns, F.col("top.first.doc_id").alias("kept_doc_id"), F.col("top.first.start").alias("kept_start"))
    return spans.unionByName(copies)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_RUN) -> DataFrame:
    """A row for every passage to remove: doc_id, start, end, words, kept_doc_id, kept_start.

    ``kept_doc_id`` and ``kept_start`` are the place of the earlier occurrence of the passage's
    first ``min_words`` words.  Offsets are code points.  Rows of null id or text and texts of
    fewer words have none; rows that repeat both id and text are one document.  Empty input:
    empty result.
    """
    return _spans(_documents(docs, id_col, text_col), min_words).drop("version")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_RUN) -> DataFrame:
    """doc_id, clean_text and removed of every row, as ``line_dedup`` gives them for lines.

    For both, give this one the texts that ``line_dedup`` leaves.
    """
    docs = _documents(docs, id_col, text_col)
    span = F.struct("start", "end", "words", "kept_doc_id", "kept_start")
    removed = _spans(docs, min_words).groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(span)).alias("removed"))
    out = docs.join(removed, ["doc_id", "version"], "left").select(
        "doc_id", "text", F.coalesce("removed", F.array().cast(_REMOVED)).alias("removed")
    )
    return out.mapInArrow(_cut, f"doc_id bigint, clean_text string, removed {_REMOVED}")
