"""Every stage's decisions on a small table, held against plain Python on the stage's own input."""

import corpus_pipeline as P
from lookout.llm import decontaminate as D
from lookout.llm import pii

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near-dedup", "decontamination", "personal data", "packing"]

    judged = {r.doc_id: r.kept for r in P.quality_posteriors(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    first = P.written(stage["quality classifier"](spark, docs, SF), "t1")
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {d for d, k in judged.items() if k}

    rows = [(r.doc_id, r.text) for r in first.collect()]
    second = P.written(stage["near-dedup"](spark, first, SF), "t2")
    want = {d for d, (_, c) in brute.near_duplicates(rows).items() if c == d}
    assert second.columns == columns and {r.doc_id for r in second.collect()} == want

    items = [D.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = P.written(stage["decontamination"](spark, second, SF), "t3")
    left = {r.doc_id for r in third.collect()}
    for r in second.collect():
        if any(i in D.normalised(r.text) for i in items if len(i) >= D.MIN_CHARS):
            assert r.doc_id not in left
    assert len(left) > 0.8 * second.count()

    fourth = P.written(stage["personal data"](spark, third, SF), "t4")
    assert fourth.columns == columns and fourth.count() == third.count()
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        spans = pii.base_spans(before[r.doc_id])
        assert all(before[r.doc_id][a:b] not in r.text for a, b, k in spans if k in (0, 3)) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "[" in r.text

    packed = stage["packing"](spark, fourth, SF).collect()
    assert {r.doc_id for r in packed} == left


def test_run_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (None, "no id")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in P.near_dedup(spark, docs, SF).collect()) == ["1", "None"]
