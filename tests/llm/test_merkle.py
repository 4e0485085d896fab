import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lookout.llm import merkle
from lookout.llm.merkle import append_log, leaf, manifest, numbered_leaves, positions

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def path(all_levels, index):
    """[(sibling or None, whether it stands on the left)] from the leaf up."""
    out = []
    for level in all_levels[:-1]:
        sibling = index ^ 1
        out.append((level[sibling] if sibling < len(level) else None, index & 1))
        index >>= 1
    return out


def brute(rows):
    groups = {}
    for r in rows:
        own = H(*(shown(r[c]) for c in COLUMNS))
        given = own
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            given = H(*(shown({**r, "n_chars": r["n_chars"] + 1}[c]) for c in COLUMNS))
        groups.setdefault(r["lang"], []).append((r["doc_id"], own, given))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[g] = levels([x[1] for x in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (doc, own, given) in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            folded = given
            for sibling, left in steps:
                folded = H(folded) if sibling is None else H(sibling, folded) if left else H(folded, sibling)
            proof = H(*(s for s, _ in steps if s is not None))
            out.append((doc, own, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, **options):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], schema).repartition(3)
    df = df.selectExpr("*", "'clash' AS tree", "1 AS idx", "2 AS n", "'x' AS digest", "'y' AS leaf", "3 AS tampered")
    other = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    got = manifest(df, tampered=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, other), **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


def row(doc, lang="en", text="some text", n=3, source="s"):
    return {"doc_id": doc, "source": source, "lang": lang, "n_chars": n, "text": text}


@pytest.mark.parametrize("bits", [merkle.LEVELS, 2])
def test_equals_brute_force(spark, bits):
    """Also with builders so small that a tree has many tiers."""
    rows = [row(k, lang, f"text {k} é") for lang, n in (("en", 37), ("de", 16), ("fr", 1), (None, 5), ("", 2), ("ß", 9))
            for k in range(len(lang or "x") * 100, len(lang or "x") * 100 + n)]
    assert found(spark, rows, levels=bits) == brute(rows)


def test_edges(spark):
    rows = [
        row(None), row(1), row(1), row(1, text=None), row(1, n=None), row(2, text=""), row(3, lang=None, source=None),
        row(-7, text="x" * 100_000), row(4, lang="", n=None, text="ü\n"),
    ]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == len(rows)
    assert found(spark, rows[1:2]) == brute(rows[1:2])
    assert found(spark, rows[:0]) == []
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert all(r.verified for r in manifest(df).collect())


def test_log_is_in_postorder(spark):
    for n in (1, 2, 3, 11, 1025, 3000):
        leaves = spark.range(n).selectExpr("'t' AS tree", "id AS doc_id", "sha2(CAST(id AS STRING), 256) AS digest")
        log = sorted(append_log(numbered_leaves(leaves, ["doc_id"])).collect(), key=lambda r: r.position)
        want = levels([H(str(k)) for k in range(n)])
        order = []

        def visit(level, index):
            if level:
                for child in (2 * index, 2 * index + 1):
                    if child < len(want[level - 1]):
                        visit(level - 1, child)
            order.append((level, index))

        visit(len(want) - 1, 0)
        assert [(r.level, r.idx) for r in log] == order
        assert [r.position for r in log] == list(range(len(order)))
        assert [r.digest for r in log] == [want[level][index] for level, index in order]


def test_positions_of_a_chain():
    import numpy as np

    # 5 leaves: 0 1 (2) 3 4 (5) (6) 7 (8) (9) (10)
    assert positions(0, np.arange(5), 5).tolist() == [0, 1, 3, 4, 7]
    assert [positions(k, np.array([i]), 5)[0] for k, i in ((1, 0), (1, 1), (2, 0), (1, 2), (2, 1), (3, 0))] == [2, 5, 6, 8, 9, 10]
