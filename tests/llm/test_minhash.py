import random

import pytest
from pyspark.sql import functions as F

from lookout.llm import minhash
from lookout.llm.components import components
from lookout.llm.minhash import near_duplicates

from . import brute

SCHEMA = "doc_id long, text string, n_chars string, bucket int"


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def _edited(base, rng, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "A  b"), (5, "b a"), (6, "one")]
    for k in range(120):
        rows.append((10 + k, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(10, 90))])))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(150):
        rows.append((200 + k, _edited(base, rng, rng.randrange(0, 6))))
    for k in range(40):
        rows.append((400 + k, " ".join(base[: 60 + k])))
    rng.shuffle(rows)
    assert run(spark, rows) == brute.near_duplicates(rows)


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == brute.near_duplicates(rows)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B C D E F"), (11, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (11, 1, 11, True)], key=str
    )
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 17])
def test_components_of_a_chain(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(n + 1)}


def test_last_meeting_carries_no_bands_and_meets_a_pair_once(spark):
    placed = [(10, 1, 1), (10, 2, 2), (10, 3, 1), (20, 1, 1), (20, 2, 2), (30, 2, 2), (30, 3, 1), (40, 4, 4), (40, 5, 4)]
    placed = spark.createDataFrame(placed, "bucket long, node long, component long")
    nodes = spark.createDataFrame([(k, 9, [k], [k] * 60) for k in range(1, 9)], "node long, n long, bits array<long>, bands array<long>")
    found = minhash._cross_pairs(placed, nodes, lambda x, y: F.expr(f"{x}.n = {y}.n"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (2, 3)]
    assert "bands" not in found._jdf.queryExecution().executedPlan().toString()
