"""Operator 9: packing token sequences by cutting-stock column generation.

Every document's ids are cut into pieces of ``length`` ids and a remainder.  Piece lengths,
rounded up to ``QUANTUM`` ids, make a histogram of at most length / QUANTUM classes, which is
all that the driver sees.  ``cutting_stock`` turns it into patterns with counts.  The pieces of
a class are numbered over the cluster, and a pattern that takes a pieces of a class in n
sequences owns the next a * n numbers, so each piece finds its sequence by its number alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, written
from .cutting_stock import solve
from .word_ids import word_ids
from .words import released

LENGTH = 2048
QUANTUM = 8
END_ID = 1
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _pieces(tokenizer: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = word_ids(tokenizer)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([ids_of.encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                for start in range(0, len(ids), length):
                    own = ids[start : start + length]
                    rows.append((doc, start, len(own), zlib.crc32(own), len(ids)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _plan(spark: SparkSession, patterns: list[tuple[dict[int, int], int]]) -> DataFrame:
    """Which numbers of a class go to which sequences: at most a few rows a class."""
    rows, next_number, sequence = [], {}, 0
    for pattern, times in patterns:
        for size, per in pattern.items():
            low = next_number.get(size, 0)
            next_number[size] = low + per * times
            rows.append((size, low, low + per * times, per, sequence))
        sequence += times
    return spark.createDataFrame(rows, "units int, low long, high long, per long, base long")


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = LENGTH,
    quantum: int = QUANTUM,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.  Null or
    wordless text has the end id alone.  Null ids and repeated rows are packed like any row.
    A piece of a sequence starts where the one before ends.  Other columns are ignored,
    whatever their names.  Empty input: empty result.
    """
    if length < 1 or quantum < 1 or length % quantum:
        raise ValueError("length must be a positive multiple of quantum")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(docs.mapInArrow(released(_pieces(tokenizer, length)), _PIECES), "pieces")
    pieces = pieces.withColumn("units", F.ceil(F.col("length") / F.lit(quantum)).cast("int"))
    # at most length / quantum rows reach the driver
    histogram = {r["units"]: r["n"] for r in pieces.groupBy("units").agg(F.count("*").alias("n")).collect()}
    plan = _plan(spark, solve(histogram, length // quantum))
    order = ["doc_id", "start", "length", "ids_crc32"]
    ranked = numbered(pieces, ["units"], order, "number", sum(histogram.values()))
    # bounded: a basis has one pattern a class, and the leftovers of rounding are a few more
    hit = (F.col("p.units") == F.col("q.units")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    placed = ranked.alias("p").join(F.broadcast(plan).alias("q"), hit).select(
        *order,
        "doc_tokens",
        (F.col("base") + F.expr("(number - low) div per")).alias("sequence_id"),
        F.col("p.units").alias("units"),
        "number",
    )
    within = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "number")
    offset = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset.cast("long")).drop("units", "number")
