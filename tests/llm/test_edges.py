"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest

from lookout.llm.decontaminate import leaks
from lookout.llm.licenses import scan
from lookout.llm.line_dedup import line_dedup
from lookout.llm.line_rules import line_rules
from lookout.llm.lm_scoring import lattice_scores
from lookout.llm.minhash import near_duplicates
from lookout.llm.packing import pack
from lookout.llm.pii import personal_data
from lookout.llm.quality import quality_posteriors
from lookout.llm.registry import tokenizer_path
from lookout.llm.sharding import shard

LONG = "word " * 30_000 + "x" * 100_000
ROWS = [
    (None, "text without an id and some more words", "h", "en", 7),
    (1, None, None, None, None),
    (2, "", "h", "en", 0),
    (3, LONG, "h", None, len(LONG)),
    (4, "the same row twice, with quite a few words in it", "h", "en", 5),
    (4, "the same row twice, with quite a few words in it", "h", "en", 5),
    (5, "the same row twice, with quite a few words in it", None, "en", 5),
    (6, "\n \t\n", "g", "fr", 4),
]
CLASH = ["row", "lines", "bands", "bucket", "node", "component", "w", "g", "n", "h1", "axis0", "units", "version", "digest", "rest", "path", "spans", "kept", "score", "token"]


def _labels(spark):
    return spark.createDataFrame([(4, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


def _bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "the same row twice, with quite a few words in it")], "item_id long, text string")


OPERATORS = {
    "near_duplicates": lambda s, d: near_duplicates(d),
    "shard": lambda s, d: shard(d),
    "quality": lambda s, d: quality_posteriors(d, _labels(s)),
    "line_dedup": lambda s, d: line_dedup(d),
    "lattice": lambda s, d: lattice_scores(d, tokenizer_path("piece_bpe_32k.model"), rounds=1),
    "licenses": lambda s, d: scan(d),
    "line_rules": lambda s, d: line_rules(d),
    "pii": lambda s, d: personal_data(d),
}


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.selectExpr("*", *(f"'clash' AS {c}" for c in CLASH))


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(spark, name):
    got = OPERATORS[name](spark, _docs(spark, ROWS)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, _docs(spark, ROWS).limit(0)).count() == 0


def test_packing_and_leaks(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = _docs(spark, ROWS)
    got = pack(docs, path).collect()
    assert sorted((r.doc_id for r in got if r.start == 0), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert {r.doc_id: r.doc_tokens for r in got}[2] == 1
    found = leaks(docs, _bench(spark)).collect()
    assert sorted(r.doc_id for r in found) == [4, 4, 5] and {r.item_id for r in found} == {None}
    empty = docs.limit(0)
    assert pack(empty, path).count() == 0 and leaks(empty, _bench(spark)).count() == 0
    assert leaks(docs, _bench(spark).limit(0)).count() == 0


def test_defined_results(spark):
    docs = _docs(spark, ROWS)
    near = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert {(4, 4, True), (5, 4, False), (None, None, True), (1, 1, True), (2, 2, True)} <= near
    rules = {r.doc_id: r for r in line_rules(docs).collect()}
    assert rules[1].n_words == 0 and rules[1].base_failed and not rules[1].kept and rules[3].n_words == 30_001
    cut = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert cut[4].removed == [] and len(cut[5].removed) == 1 and cut[5].clean_text == ""
    assert cut[1].clean_text is None and cut[2].clean_text == ""
    judged = quality_posteriors(docs, _labels(spark).limit(0)).collect()
    assert all(r.kept for r in judged)
