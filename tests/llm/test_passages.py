"""Repeated passages against plain Python, and by hand."""

import random

from lookout.llm import registry
from lookout.llm.passages import passages, without_passages

from . import brute


def _brute(rows, size):
    """{doc_id: words to remove} for unique ids."""
    first, gone = {}, {}
    for d, t in sorted(rows):
        w = [brute.lower(x) for x in brute.words(t)]
        gone[d] = set()
        for i in range(len(w) - size + 1):
            e, j = first.setdefault(tuple(w[i : i + size]), (d, i))
            if e != d or i >= j + size:
                gone[d] |= set(range(i, i + size))
    return gone


def _covered(rows, found):
    text, got = dict(rows), {d: set() for d, _ in rows}
    for r in found:
        before, inside = brute.words(text[r.doc_id][: r.start]), brute.words(text[r.doc_id][r.start : r.end])
        assert r.words == len(inside)
        got[r.doc_id] |= set(range(len(before), len(before) + len(inside)))
    return got


def test_mid_line_and_short_lines(spark):
    passage = [f"Wörd{k}" for k in range(54)]
    flat, wrapped = " ".join(passage), "\n".join(" ".join(passage[k : k + 5]) for k in range(0, 54, 5))
    rows = [(1, f"é one two {flat} three four"), (2, f"other words {flat.replace('W', 'w')} end\nlast"), (3, f"head\n{wrapped}\ntail"), (4, None), (None, flat), (5, f"at the end {flat}\nnext")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in without_passages(df).collect()}
    assert got[1].clean_text == rows[0][1] and got[1].removed == [] and got[4].clean_text is None and got[None].clean_text == flat
    assert got[2].clean_text == "other words  end\nlast" and got[3].clean_text == "head\ntail"
    assert [(s.words, s.kept_doc_id, s.kept_start) for s in got[2].removed + got[3].removed] == [(54, 1, 10)] * 2
    assert got[5].clean_text == "at the end \nnext"


def test_against_plain_python(spark):
    rng = random.Random(5)
    source = [rng.choice("abcdefgh") for _ in range(150)]
    rows = [(0, "x " * 31), (1, "a b c " * 9)]
    for d in range(2, 60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(150)
            parts += source[i : i + rng.randrange(30)] + [f"u{rng.randrange(9)}"] * rng.randrange(3)
        rows.append((d, "".join(x + rng.choice([" ", "\n", "  "]) for x in parts)))
    rows += [(60, rows[7][1].upper()), (61, rows[9][1])]
    df = spark.createDataFrame(rows + rows[5:9], "doc_id long, text string").repartition(5)
    for size in (9, 10):
        assert _covered(rows, passages(df, min_words=size).collect()) == _brute(rows, size)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    assert _covered(rows, registry.QUERIES["op4_passages"](spark, "/root/testdata/sf0.001").collect()) == _brute(rows, 50)
