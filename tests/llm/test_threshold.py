import math
import random

import pytest
from pyspark.sql import functions as F

from lookout.llm.threshold import Lists, exact_top_k


def brute(rows, k, every):
    """[(query_id, rank, vec_id, score)] in plain integers."""
    clean = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in clean:
        if q is None or q % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in clean if i != q]
        scored = [(max(-(2**63), min(2**63 - 1, s)), i) for s, i in scored]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(spark, rows, k=5, every=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.selectExpr("*", "'clash' AS id", "'clash' AS key", "1 AS block", "2 AS kind", "'x' AS vector", "3 AS rank")
    got = exact_top_k(df, F.col("vec_id") % every == 0, k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_equals_brute_force_over_blocks(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # many copies of one vector: ties
    rows += [(2000, [0.0] * 6), (2005, [0.0] * 6)]
    want = brute(rows, 5, 5)
    assert found(spark, rows) == want
    assert found(spark, rows, block=40) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (None, [1.0, 1.0]),
        (0, [1.0, -1.0]),
        (5, None),
        (10, [1.0, None]),
        (15, [nan, 1.0]),
        (20, [inf, 1.0]),
        (25, []),
        (30, [0.5]),
        (-5, [1.0, 0.0, 3.0]),
        (35, [1e15, -1e15]),
        (36, [1e15, 1e15]),
        (40, [0.2, 0.2]),
        (40, [0.2, 0.2]),
    ]
    for k in (1, 5, 50):
        assert found(spark, rows, k) == brute(rows, k, 5)
    assert found(spark, rows[:0]) == [] and found(spark, rows[1:2]) == []
    with pytest.raises(ValueError, match="at least 1"):
        exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 0)


def test_walk_stops_early():
    """Where one dimension tells, the threshold ends the walk before the lists do."""

    class Counted(Lists):
        looked = 0

    lists = Counted(list(range(5000)), [[10 * i, i % 7] for i in range(5000)])
    real = lists.rows

    class Watched:
        shape = real.shape

        def __getitem__(self, at):
            part = real[at]
            if part.ndim == 2:
                Counted.looked += len(part)
            return part

    lists.rows = Watched()
    rows, scores = lists.best([1, 1], 4999, 3)
    assert scores.tolist() == [49980 + 4998 % 7, 49970 + 4997 % 7, 49960 + 4996 % 7] and rows.tolist() == [4998, 4997, 4996]
    assert Counted.looked < 200
