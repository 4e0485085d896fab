"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``docs``, with rows dropped or texts changed.
``run`` writes every stage's result into the shared folder and gives the next one the reread
table, so a lost executor never recomputes an earlier stage.

Stages that drop rows give each row a written key first and drop exactly the rows that were
judged, whatever their ids: null ids are judged like any, and rows that share an id one by one.
A null text counts as empty.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookout.llm.common import table, without, written
from lookout.llm.decontaminate import leaks
from lookout.llm.minhash import near_duplicates
from lookout.llm.packing import pack
from lookout.llm.pii import redact
from lookout.llm.quality import quality_posteriors
from lookout.llm.registry import tokenizer_path

#: No SQL engine has the classifier, the field or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a key of its own for every row; and that key's name, which no column
    of ``docs`` has."""
    key = "_row"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _dropped(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return without(rows, keys, key).drop(key)


def _columns(docs: DataFrame, stage: str, *needed: str) -> None:
    missing = [c for c in needed if c not in docs.columns]
    if missing:
        raise ValueError(f"the {stage} stage needs the columns {missing}")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _columns(docs, "quality", "doc_id", "text", "source", "lang")
    rows, key = _rows(docs)
    judged = quality_posteriors(rows, table(spark, sf_dir, "labels"), key_col=key)
    return _dropped(rows, judged.where("not kept").select("doc_id"), key)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the least id, null ids last."""
    _columns(docs, "near-dedup", "doc_id", "text")
    rows, key = _rows(docs)
    groups = written(near_duplicates(rows, key).select(F.col("doc_id").alias("row"), "component_id"), "groups")
    # texts stay where they are: ranks and keys alone are grouped
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(key).alias("row"))
    ranked = rows.select(F.col(key).alias("row"), rank.alias("rank")).join(groups, "row")
    stays = ranked.groupBy("component_id").agg(F.min("rank").alias("least")).select(F.col("least.row").alias("row"))
    return _dropped(rows, groups.select("row").join(stays, "row", "left_anti"), key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _columns(docs, "decontamination", "doc_id", "text")
    rows, key = _rows(docs)
    return _dropped(rows, leaks(rows, table(spark, sf_dir, "benchmark"), key).select("doc_id"), key)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets."""
    _columns(docs, "personal data", "text", "n_chars")
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences: a row for every piece."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal data", private),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
