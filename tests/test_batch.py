"""Batch search; blocked (with and without salting) == scan == brute force."""

import random
from collections import Counter

import pytest

from lookout import SearchConfig, batch_search
from lookout.functions.patterns import wildcard_pattern_text

from conftest import SF_SMALL

WORDS = ["red", "ring", "hot", "plate", "a_b", "100%", "ab", "b", "zz", "Ring"]


def brute_force(rows, queries, cfg):
    """Plain-Python top-k per query with LIKE semantics via Python regex."""
    import re

    def like_regex(p):
        out, i = "", 0
        while i < len(p):
            c = p[i]
            if c == "\\" and i + 1 < len(p):
                out += re.escape(p[i + 1])
                i += 2
                continue
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
            i += 1
        return re.compile(out, re.S | (0 if cfg.case_sensitive else re.I))

    result = set()
    for qid, text, k in queries:
        if text is None or len(text) < cfg.min_length:
            continue
        rx = like_regex(wildcard_pattern_text(text, cfg.escape_spec_chars, cfg.backslash))
        hits = sorted(
            (name, key) for key, name in rows if name is not None and rx.fullmatch(name.lower() if not cfg.case_sensitive else name)
        )
        for rank, (name, key) in enumerate(hits[:k], 1):
            result.add((qid, rank, key))
    return result


def run(spark, rows, queries, cfg, **kw):
    df = spark.createDataFrame(rows, "key long, name string")
    q = spark.createDataFrame(queries, "query_id long, text string, k int")
    out = batch_search(df, q, cfg, **kw)
    return {(r.query_id, r.rank, r.key) for r in out.select("query_id", "rank", "key").collect()}


CFG = SearchConfig(search_column="name", tie_break=("key",), extra_columns=("key",))


def random_case(seed):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 4))) or None) for i in range(120)]
    queries = [
        (j, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 2))) + rnd.choice(["", " ", "   "]), rnd.randint(0, 6))
        for j in range(25)
    ]
    queries += [(100, "   ", 3), (101, "zz", 3), (102, "ring\\", 2), (103, "RING", 4), (104, "RING", 1)]
    return rows, queries


@pytest.mark.parametrize("seed", [1, 2])
def test_strategies_agree_with_brute_force(spark, seed):
    rows, queries = random_case(seed)
    want = brute_force(rows, queries, CFG)
    assert run(spark, rows, queries, CFG, strategy="scan") == want
    assert run(spark, rows, queries, CFG, strategy="blocked") == want
    # force salting of every gram: many salts per hot gram, same answer
    assert run(spark, rows, queries, CFG, strategy="blocked", rows_per_salt=3) == want
    # force the non-broadcast join paths
    assert run(spark, rows, queries, CFG, strategy="blocked", max_literal_grams=0, max_broadcast_hits=0) == want
    assert run(spark, rows, queries, CFG, strategy="scan", max_broadcast_hits=0) == want
    # salted join back: every pattern with more than one query is "hot"
    assert run(spark, rows, queries, CFG, strategy="blocked", max_broadcast_hits=0, queries_per_salt=1) == want


def test_precomputed_gram_stats(spark):
    from lookout.operators.batch import gram_frequencies

    rows, queries = random_case(5)
    want = brute_force(rows, queries, CFG)
    df = spark.createDataFrame(rows, "key long, name string")
    stats = gram_frequencies(df, CFG)
    assert run(spark, rows, queries, CFG, strategy="blocked", gram_stats=stats) == want


def test_case_sensitive_and_escape(spark):
    rows, queries = random_case(3)
    for cfg in (CFG.replace(case_sensitive=True), CFG.replace(escape_spec_chars=True)):
        want = brute_force(rows, queries, cfg)
        assert run(spark, rows, queries, cfg, strategy="blocked") == want
        assert run(spark, rows, queries, cfg, strategy="scan") == want


def test_scan_beyond_its_bound_is_blocked(spark):
    rows, queries = random_case(4)
    want = brute_force(rows, queries, CFG)
    assert run(spark, rows, queries, CFG, strategy="scan", max_scan_patterns=2) == want


def test_unlimited_queries(spark):
    rows = [(i, f"red ring {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "key long, name string")
    q = spark.createDataFrame([(1, "ring", None), (2, "red", 2), (3, "ring", 0)], "query_id long, text string, k int")
    for limit, mode in ((None, "top_k"), (0, "unordered"), ("lots", "unordered")):
        cfg = CFG.replace(limit=limit, limit_mode=mode)
        for strategy, bound in (("scan", 0), ("blocked", 1_000_000)) if limit is None else (("scan", 1_000_000), ("blocked", 0)):
            rows = batch_search(df, q, cfg, strategy=strategy, max_broadcast_hits=bound).collect()
            assert sorted((r.query_id, r["rank"], r.key) for r in rows if r.query_id == 2) == [(2, 1, 0), (2, 2, 1)]
            rest = [r for r in rows if r.query_id != 2]
            assert sorted(r.key for r in rest) == list(range(30))
            assert {(r.query_id, r["rank"]) for r in rest} == {(1, None)}


@pytest.mark.parametrize("strategy", ["scan", "blocked"])
def test_unlimited_hits_of_a_relation_in_one_task_are_joined_in_many(spark, monkeypatch, strategy):
    monkeypatch.setattr("lookout.operators.batch.ROWS_PER_TASK", 500, raising=False)
    df = spark.range(60).selectExpr("id AS key", "concat('red ring ', id) AS name").coalesce(1)
    q = spark.range(40).selectExpr("id AS query_id", "IF(id % 2 = 0, 'ring', 'red 1') AS text")
    hits = batch_search(df, q, CFG.replace(limit=None), strategy=strategy, k_col=None)
    ones = sum("1" in str(k) for k in range(60))
    assert hits.count() == hits.select("query_id", "key").distinct().count() == 20 * 60 + 20 * ones
    assert hits.rdd.getNumPartitions() == -(-(20 * 60 + 20 * ones) // 500)


def per_task(hits, *columns):
    """Rows and distinct values of ``columns`` in each task of ``hits``."""
    return hits.rdd.mapPartitions(lambda rows: [(len(r := [tuple(x[c] for c in columns) for x in rows]), len({*r}))]).collect()


@pytest.mark.parametrize("bound", [10, 1_000_000])
def test_tasks_of_unlimited_queries_write_few_distinct_queries_and_hits(spark, monkeypatch, bound):
    monkeypatch.setattr("lookout.operators.batch.ROWS_PER_TASK", 20_000, raising=False)
    monkeypatch.setattr("lookout.operators.batch.RUN", 30, raising=False)
    monkeypatch.setattr("lookout.operators.batch.COPIES_PER_TASK", 400, raising=False)
    df = spark.range(400).selectExpr("id AS key", "concat('red ring ', id) AS name").coalesce(1)
    q = spark.range(500).selectExpr("id AS query_id", "IF(id < 400, 'ring', 'RED ring') AS text")
    hits = batch_search(df, q, CFG.replace(limit=None), strategy="blocked", k_col=None, max_broadcast_hits=bound)
    assert hits.count() == hits.select("query_id", "key").distinct().count() == 400 * 500
    sizes, queries, keys = per_task(hits, "query_id", "key"), per_task(hits, "query_id"), per_task(hits, "key")
    assert len(sizes) == 10 and max(n for n, _ in sizes) < 2 * 20_000
    assert max(n for _, n in queries) < 400 and sum(n for _, n in queries + keys) < 0.05 * 400 * 500


def test_unlimited_queries_with_repeated_or_null_ids_keep_all_rows_in_the_tasks_there_may_be(spark, monkeypatch):
    monkeypatch.setattr("lookout.operators.batch.ROWS_PER_TASK", 50, raising=False)
    monkeypatch.setattr("lookout.operators.batch.MOST_TASKS", 7, raising=False)
    df = spark.range(60).selectExpr("IF(id < 20, 0, id) AS key", "IF(id < 20, 'ring', concat('ring ', id)) AS name")
    q = spark.range(45).selectExpr("IF(id % 3 = 0, NULL, id % 5) AS query_id", "'ring' AS text")
    hits = batch_search(df, q, CFG.replace(limit=None), strategy="scan", k_col=None)
    want = Counter((None if i % 3 == 0 else i % 5, 0 if k < 20 else k) for i in range(45) for k in range(60))
    assert Counter((r.query_id, r.key) for r in hits.collect()) == want
    sizes = per_task(hits, "query_id")
    assert len(sizes) == 7 and max(n for n, _ in sizes) < 2 * 45 * 60 / 7


def test_rows_that_meet_many_patterns_are_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr("lookout.operators.batch.PAIRS_PER_TASK", 1000, raising=False)
    rows = [(i, f"customer {i:09d}") for i in range(100)]
    queries = [(i, f"cust {i}", 3) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, name string").coalesce(1)
    hits = batch_search(df, spark.createDataFrame(queries, "query_id long, text string, k int"), CFG, strategy="blocked")
    assert {(r.query_id, r["rank"], r.key) for r in hits.collect()} == brute_force(rows, queries, CFG)
    assert "hashpartitioning(__lk_tie0" in hits._jdf.queryExecution().toString()


@pytest.mark.parametrize("bound", [0, 1_000_000])
@pytest.mark.parametrize("strategy", ["scan", "blocked"])
def test_repeated_tie_key_is_an_error_on_both_sides_of_the_bound(spark, bound, strategy):
    df = spark.createDataFrame([(7, "ring"), (7, "ring"), (7, "ring")], "key long, name string")
    q = spark.createDataFrame([(1, "ring", 2)], "query_id long, text string, k int")
    with pytest.raises(Exception, match="not unique"):
        batch_search(df, q, CFG, strategy=strategy, max_broadcast_hits=bound).collect()


@pytest.mark.parametrize("patterns", [0, 50_000])
def test_longer_grams_and_both_joins(spark, patterns):
    rows = [(i, f"customer {i:09d}") for i in range(300)]
    queries = [(i, f"Customer {i:09d}", 3) for i in range(0, 300, 7)]
    want = brute_force(rows, queries, CFG)
    assert run(spark, rows, queries, CFG, strategy="blocked", max_broadcast_patterns=patterns, spread_to=3) == want


def test_candidates_stay_near_the_answers(spark):
    from lookout.operators import batch as B

    for n in (400, 4000):  # also far beyond the rows that the choice of grams looks at
        df = spark.range(n).selectExpr("id AS key", "format_string('customer %09d', id) AS name")
        q = df.selectExpr("key AS query_id", "name AS text", "3 AS k")
        prepared = B.prepare_queries(q, CFG)
        target, pats = B._target(df, CFG), B._distinct_patterns(prepared, CFG)
        about = B._summary(prepared, CFG, 64)[True]
        sizes = about["sizes"]
        assert sizes == [3, 6] and about["patterns"] == n and about["listed"] is None
        chosen = B.choose_grams(target, pats, CFG, sizes=sizes)
        rows = B.table_grams(target, sizes, CFG, [])
        assert rows.join(chosen, [B._N, B._G]).count() <= 64 * n


@pytest.mark.parametrize("grams", [0, 1000])
def test_grams_in_the_row_and_exploded(spark, grams):
    rows, queries = random_case(9)
    want = brute_force(rows, queries, CFG)
    assert run(spark, rows, queries, CFG, strategy="blocked", max_literal_grams=grams) == want
    assert run(spark, rows, queries, CFG, strategy="blocked", max_literal_grams=grams, max_broadcast_patterns=0) == want


def test_few_patterns_do_not_explode_the_texts(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    q = spark.createDataFrame([(i, f"the {w}", 3) for i, w in enumerate("and of in to".split())], "query_id long, text string, k int")
    cfg = SearchConfig(search_column="text", tie_break=("doc_id",), display_columns=("lang",), echo_search_column=False)
    plan = batch_search(df, q, cfg, strategy="blocked")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(__lk_fold" not in plan and "contains(" in plan.lower()


def test_scan_plan_has_no_join(spark):
    df = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    q = spark.createDataFrame([(1, "red w", 3), (2, "ring", 2)], "query_id long, text string, k int")
    cfg = SearchConfig(search_column="p_name", tie_break=("p_partkey",), extra_columns=("p_partkey",))
    plan = batch_search(df, q, cfg, strategy="scan")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_hot_gram_is_salted(spark):
    rows = [(i, "common text") for i in range(200)]
    q = [(1, "common", 3), (2, "text", 2)]
    want = {(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1)}
    assert run(spark, rows, q, CFG, strategy="blocked", rows_per_salt=10) == want


def test_blocked_plan_is_equi_join(spark):
    df = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    q = spark.createDataFrame([(i, f"red {i % 7}", 3) for i in range(40)], "query_id long, text string, k int")
    cfg = SearchConfig(search_column="p_name", tie_break=("p_partkey",), extra_columns=("p_partkey",))
    plan = batch_search(df, q, cfg, strategy="blocked")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in plan


def test_internal_names_do_not_clash(spark):
    rows = [(i, f"red ring {i}", i % 3, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "key long, name string, n int, g string")
    q = spark.createDataFrame([(1, "red 1", 2), (2, "ring", 3)], "query_id long, text string, k int")
    cfg = SearchConfig(search_column="name", tie_break=("key",), extra_columns=("key", "n", "g"))
    for strategy in ("scan", "blocked"):
        out = batch_search(df, q, cfg, strategy=strategy)
        assert out.columns == ["query_id", "rank", "geom", "epsg", "suggestion", "key", "n", "g"]
        assert out.count() == 5


def test_hot_pattern_join_back_is_salted(spark):
    rows = [(i, f"ring {i}") for i in range(40)]
    queries = [(j, "RING", 2) for j in range(60)] + [(100, "ring 1", 3)]
    df = spark.createDataFrame(rows, "key long, name string")
    q = spark.createDataFrame(queries, "query_id long, text string, k int")
    out = batch_search(df, q, CFG, strategy="blocked", max_broadcast_hits=0, queries_per_salt=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__lk_qsalt" in plan
    got = {(r.query_id, r.rank, r.key) for r in out.collect()}
    assert got == brute_force(rows, queries, CFG)


def test_empty_and_short_query_sets(spark):
    rows = [(i, f"red ring {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "key long, name string")
    for queries in ([], [(1, "zz", 3), (2, None, 3)]):
        q = spark.createDataFrame(queries, "query_id long, text string, k int")
        for strategy in ("auto", "scan", "blocked"):
            out = batch_search(df, q, CFG, strategy=strategy)
            assert out.columns == ["query_id", "rank", "geom", "epsg", "suggestion", "key"]
            assert out.count() == 0


def test_null_and_zero_k(spark):
    rows = [(i, f"red ring {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "key long, name string")
    q = spark.createDataFrame([(1, "ring", None), (2, "ring", 0), (3, "red", 2)], "query_id long, text string, k int")
    got = {(r.query_id, r["rank"]) for r in batch_search(df, q, CFG.replace(limit=4), strategy="blocked").collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (3, 2)}


def test_rare_grams_are_judged_on_the_whole_table(spark):
    """The first rows of a sorted table hold neither gram; of all rows, ten hold one and one the other."""
    from lookout.operators import batch as B

    cfg = SearchConfig(search_column="name", tie_break=("key",), extra_columns=("key",))
    rows = spark.range(20_000).selectExpr("id AS key", "concat('Customer#', lpad(id, 9, '0')) AS name")
    queries = spark.createDataFrame([(1, "customer 000012345", 3)], "query_id int, text string, k int")
    pats = B._distinct_patterns(B.prepare_queries(queries, cfg), cfg)
    some, every = B.sampled(B._target(rows, cfg), 20_000, cfg)
    assert every == 1
    best = B.choose_grams(some, pats, cfg, sizes=[3, 6]).collect()
    assert [(r["__lk_g"], r["__lk_df"]) for r in best] == [("012345", 1)]
    drawn, every = B.sampled(B._target(rows, cfg), 20_000 * B.SAMPLE_CHARS, cfg)
    assert every > 1 and drawn.count() <= 4 * B.SAMPLE_CHARS
