from lookout.llm.licenses import scan


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/one.txt", "some words\nmore words that say nothing of it"),
        (3, "a/b/two.txt", "# Licensed under the Apache License, Version 2.0\n" + "code " * 40),
        (4, "c/three.txt", "nothing here"),
        (5, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "a/b/c/d/four.txt", "text"),
        (7, "top.txt", "a licence to kill is not a notice of the kind we look for"),
        (8, None, None),
        (2, "a/b/one.txt", "some words\nmore words that say nothing of it"),
    ]
    got = scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.license, r.line, r.is_license_file, r.inherited_license, r.inherited_from) for r in got}
    assert by[1] == ("MIT", 0, True, None, None)
    assert by[2] == (None, None, False, "MIT", "a")
    assert by[3][:3] == ("Apache-2.0", 0, False)
    assert by[4] == by[7] == by[8] == (None, None, False, None, None)
    assert by[5][:3] == ("GPL-3.0", 0, True) and by[6][3:] == ("GPL-3.0", "a/b/c")


def test_cosine_against_plain_python(spark):
    import math
    import re

    from lookout.llm.licenses import TEMPLATES, THRESHOLD

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    tokens = lambda t: re.findall(r"(?:[^\W_])+(?:[.][0-9]+)*", t.lower())
    vocabulary = {x for _, t in TEMPLATES for x in tokens(t)}
    df = {x: sum(x in set(tokens(t)) for _, t in rows) for x in vocabulary}
    rare = math.log((1 + len(rows)) / 2) + 1
    idf = {x: math.log((1 + len(rows)) / (1 + n)) + 1 for x, n in df.items()}

    def vector(text):
        found = tokens(text)
        v = {x: found.count(x) * idf.get(x, rare) for x in found}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    templates = [(name, vector(t)) for name, t in TEMPLATES]
    got = {r.doc_id: r for r in scan(docs.selectExpr("*", "concat_ws('/', source, doc_id) AS path")).collect()}
    for d, text in rows:
        best = 0.0
        for line in text.split("\n"):
            low = line.lower()
            if tokens(line) and any(m in low for m in ("licen", "copyright", "public domain", "all rights reserved")):
                v = vector(line)
                best = max(best, *(sum(x * v.get(k, 0) for k, x in t.items()) for _, t in templates))
        assert (got[d].score is not None) == (best >= THRESHOLD)
        assert got[d].score is None or abs(got[d].score - best) < 1e-6
