"""Operators 4 and 8 against SQL on whole small tables, and by hand."""

import re

import duckdb
import pytest

from lookout.llm import registry
from lookout.llm.line_dedup import line_dedup
from lookout.llm.line_rules import clean_text, line_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op8_quality_rules"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()))
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want


def test_removed_units_and_offsets(spark):
    long = "one two  three four five six seven EIGHT"
    same = "One two three four\tfive six seven eight "
    rows = [(2, f"é {long}x\n{same}\nshort line"), (1, f"a\n{long}\n{long}"), (3, "short line"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    assert [(s.start, s["end"], s.words, s.kept_doc_id, s.kept_start) for s in got[1].removed] == [(43, 83, 8, 1, 2)]
    (span,) = got[2].removed
    assert rows[0][1][span.start : span["end"]] == same and (span.kept_doc_id, span.kept_start) == (1, 2)
    assert got[1].clean_text == f"a\n{long}\n" and got[2].clean_text == f"é {long}x\nshort line"
    assert got[3].removed == [] and got[3].clean_text == "short line" and got[4].clean_text is None


def test_sentences_and_runs(spark):
    """Repeats that begin and end within lines; short sentences go in long enough runs only."""
    run = "One two. Three four five! Six seven eight nine. Ten eleven?"
    rows = [
        (1, f"Own words here. {run} More own words"),
        (2, f"é Other line. {run} And an end.\nOne two. Alone here."),
        (3, "Three four five!\n\n  Six seven eight nine. Ten eleven?\nrest"),
        (4, run),
        (5, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup(df, unit="sentence", min_words=9).collect()}
    assert got[1].removed == [] and got[1].clean_text == rows[0][1]
    spans = got[2].removed
    assert [rows[1][1][s.start : s["end"]] for s in spans] == ["One two. ", "Three four five! ", "Six seven eight nine. ", "Ten eleven? "]
    assert got[2].clean_text == "é Other line. And an end.\nOne two. Alone here."
    assert {s.kept_doc_id for s in spans} == {1} and [s.kept_start for s in spans][0] == 16
    assert got[3].clean_text == "\nrest" and [s.words for s in got[3].removed] == [3, 4, 2]
    assert got[4].clean_text == "" and got[5].clean_text == ""
    assert all(r.removed == [] for r in line_dedup(df, unit="sentence", min_words=12).collect())
    with pytest.raises(ValueError, match="unit must be"):
        line_dedup(df, unit="word")


def test_paragraphs(spark):
    block = "alpha beta gamma delta\nepsilon zeta eta theta"
    df = spark.createDataFrame([(1, f"x\n\n{block}\n\ny"), (2, f"{block}\n \nz")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup(df, unit="paragraph").collect()}
    assert got[1].removed == [] and got[2].clean_text == " \nz"


def test_depleted_documents_go_and_copies_do_not_count(spark):
    menu = "home about contact terms of service and privacy policy and all the rest of it"
    rows = [(k, "h", f"{menu}\nw{k} and some words that only this document has among all of the others here") for k in range(30)]
    rows += [(100, "h", menu), (101, "other", menu)]
    rows += [(200 + k, "copies", "a copied text of quite some words that is " + "really " * 12 + "long enough") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = line_rules(df)
    got = {r.doc_id: r for r in found.collect()}
    assert got[0].removed_lines == [0] and got[0].kept and got[0].n_removed_words == 15
    assert got[101].removed_lines == [] and got[200].removed_lines == []
    joined = df.join(found, "doc_id").where("doc_id = 3").select(clean_text(df.text, found.removed_lines).alias("t")).first()
    assert joined.t == rows[3][2].split("\n")[1]


def test_repeated_units_are_dealt_by_document_once(spark):
    docs = spark.createDataFrame([(k, "one two three four\nfive six") for k in range(4)], "doc_id long, text string")
    found = line_dedup(docs, min_words=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert not [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if x.startswith("doc_id#") and "at#" in x]
    assert [r["clean_text"] for r in found.orderBy("doc_id").collect()] == ["one two three four\nfive six", "", "", ""]


def test_texts_that_lose_nothing_stay_where_they_are(spark, monkeypatch):
    rows = [(1, "one two three four"), (2, "five six\none two three four"), (3, "seven"), (4, None), (None, "one two three four")]
    # rows of one id are told apart by their texts
    rows += [(7, "eight nine ten"), (7, "own words\neight nine ten"), (8, "eight nine ten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup(docs, min_words=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    got = sorted(map(repr, found.collect()))
    clean = sorted((r.doc_id or 0, r.clean_text or "") for r in found.collect())
    kept = ("eight nine ten", "own words\n")
    assert clean[:5] == [(0, "one two three four"), (1, "one two three four"), (2, "five six\n"), (3, "seven"), (4, "")]
    assert clean[5:] in ([(7, kept[0]), (7, kept[1]), (8, "")], [(7, ""), (7, "own words\neight nine ten"), (8, "")])
    # above the bounds: joined by shuffles, the same rows
    for name in ("MAX_IDS", "MAX_DIGESTS", "MAX_GROUPS"):
        monkeypatch.setitem(line_dedup.__globals__, name, 0)
    assert sorted(map(repr, line_dedup(docs, min_words=3).collect())) == got


def test_versions_of_ids_that_repeat_only(spark):
    versions = line_dedup.__globals__["_versions"]
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.version for r in versions(docs).collect()}
    assert len(got) == 5 and got[1, "a"] == 0 and len({0, got[2, "b"], got[2, "c"]}) == 3
