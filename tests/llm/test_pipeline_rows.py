"""Stages drop exactly the rows they judged, with null and repeated ids."""

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def _left(stage, spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    return sorted((str(r.doc_id), r.text) for r in out.collect())


def test_decontamination(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    bad, clean = f"before {item} after", "a text that holds nothing of the kind"
    rows = [(None, bad, "en", "s", 1), (None, clean, "en", "s", 1), (7, bad, "en", "s", 1), (7, clean, "en", "s", 1)]
    assert _left(P.decontaminate, spark, rows) == [("7", clean), ("None", clean)]


def test_near_dedup(spark):
    one, two = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(None, one, "en", "s", 1), (5, one, "en", "s", 1), (5, two, "en", "s", 1), (4, two + " x", "en", "s", 1), (5, "third", "en", "s", 1)]
    assert _left(P.near_dedup, spark, rows) == [("4", two + " x"), ("5", "third"), ("5", one)]
