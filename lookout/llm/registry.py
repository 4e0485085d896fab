"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .alignment import align_tokens
from .common import table
from .decontaminate import leaks
from .licenses import scan
from .line_dedup import line_dedup
from .line_rules import line_rules
from .lm_scoring import lattice_scores
from .merkle import leaf, manifest
from .minhash import near_duplicates
from .packing import pack
from .passages import passages
from .pii import personal_data
from .quality import quality_posteriors
from .sharding import shard
from .threshold import exact_top_k


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: what is left, and the removed sentences with their places and those that stay.

    Not kept: a document that had words and has none left.
    """
    found = line_dedup(table(spark, sf_dir, "documents"), unit="sentence", min_words=25)
    removed = F.transform(
        "removed", lambda r: F.concat_ws(":", r["start"], r["end"], r["words"], r["kept_doc_id"], r["kept_start"])
    )
    left = F.coalesce(F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return found.select(
        "doc_id",
        "clean_text",
        (left | (F.size("removed") == 0)).alias("kept"),
        F.array_join(removed, ",").alias("removed"),
    )


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every removed passage of 50 words or more, wherever lines break."""
    return passages(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own: a document is a file named by its id in source/lang."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", "doc_id")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document and benchmark item that it holds."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules(table(spark, sf_dir, "documents"))
    return found.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose id is divisible by 50."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    return align_tokens(docs, tokenizer_path("byte_bpe_50k.json"), ranks, pattern, tokenizer_path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row or so is handed over with another number of characters."""
    docs = table(spark, sf_dir, "documents")
    other = leaf([F.col(c) for c in ("doc_id", "source", "lang")] + [F.col("n_chars") + 1, F.col("text")])
    return manifest(docs, tampered=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, other))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_substring_dedup": op4_substring_dedup,
    "op4_passages": op4_passages,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_license_scans": op6_license_scans,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = dict(oracle.SQL)
