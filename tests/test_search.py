"""B4, B10-B14, B14g, B16: single search and multi-config search."""

import pytest
from pyspark.sql import functions as F

from lookout import SearchConfig, multi_search, search

ROWS = [
    (1, "Red Widget", "Brand#1", "POINT (1 2)", 4326),
    (2, "red wagon", None, "POINT (3 4)", 4326),
    (3, "blue widget", "Brand#2", None, 4326),
    (4, "Rot Weiß", "Brand#3", "LINESTRING (0 0, 1 1)", 4326),
    (5, None, "Brand#4", "POINT (0 0)", 4326),
    (6, "red w", "Brand#5", "POINT (5 5)", 4326),
    (7, "red w", "Brand#6", "POINT (6 6)", 4326),
]
SCHEMA = "id long, name string, brand string, geom string, srid int"


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


CFG = SearchConfig(
    search_column="name",
    tie_break=("id",),
    display_columns=("brand",),
    geom_column="geom",
    srid="srid",
    extra_columns=("id",),
)


def ids(df):
    return [r.id for r in df.collect()]


def test_basic_order_and_shape(table):
    out = search(table, "red w", CFG)
    assert out.columns == ["geom", "epsg", "suggestion", "id"]
    # ordered by raw name (binary collation: upper case first), then id
    assert ids(out) == [1, 6, 7, 2]
    assert out.first().suggestion == "Red Widget, Brand#1"


def test_min_length_gate(table):
    assert search(table, "re", CFG).count() == 0
    assert search(table, "   ", CFG).count() == 6  # blank text matches every non-null name


def test_case_sensitive(table):
    assert ids(search(table, "red w", CFG.replace(case_sensitive=True))) == [6, 7, 2]


def test_non_ascii_case_folding(table):
    assert ids(search(table, "rot weiss", CFG)) == []
    assert ids(search(table, "ROT WEIß", CFG)) == [4]


def test_limit_modes(table):
    assert ids(search(table, "red w", CFG.replace(limit=2))) == [1, 6]
    assert ids(search(table, "red w", CFG.replace(limit=0))) == []
    assert len(ids(search(table, "red w", CFG.replace(limit="many")))) == 4
    any_n = ids(search(table, "red w", CFG.replace(limit=2, limit_mode="any_n")))
    assert len(any_n) == 2 and any_n == sorted(any_n, key=lambda i: ([1, 6, 7, 2].index(i)))
    assert len(ids(search(table, "red w", CFG.replace(limit=0, limit_mode="unordered")))) == 4


def test_numeric_search_column(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "k")
    cfg = SearchConfig(search_column="k", tie_break=("k",), extra_columns=("k",))
    got = [r.k for r in search(df, "1 9", cfg).collect()]
    assert got == sorted(k for k in range(300) if "1" in str(k) and "9" in str(k)[str(k).index("1") + 1 :])


def test_extra_columns(table):
    cfg = CFG.replace(extra_columns=("id", "brand", "id", "missing"), on_missing_extra="empty")
    out = search(table, "blue", cfg)
    assert out.columns == ["geom", "epsg", "suggestion", "id", "brand", "missing"]
    assert out.first().missing == ""
    with pytest.raises(ValueError):
        search(table, "blue", CFG.replace(extra_columns=("missing",)))


def test_extra_struct(table):
    out = search(table, "blue", CFG.replace(extra_columns=("id", "brand")), extra_struct=True)
    assert out.first().extra.asDict() == {"id": 3, "brand": "Brand#2"}


def test_validation(table):
    with pytest.raises(ValueError):
        search(table, "red", CFG.replace(search_column="nope"))
    with pytest.raises(ValueError, match="geom_missing"):
        search(table, "red", CFG.replace(geom_column="geom_missing"))
    with pytest.raises(ValueError):
        SearchConfig(search_column="name", tie_break=())
    with pytest.raises(ValueError):
        SearchConfig(search_column="name", tie_break=("id",), data_type="shapefile")


def test_authid_srid(spark):
    df = spark.createDataFrame([(1, "abc", "EPSG:27700"), (2, "abd", "USER:1")], "id long, name string, a string")
    cfg = SearchConfig(search_column="name", tie_break=("id",), authid_column="a")
    assert [r.epsg for r in search(df, "ab ", cfg).collect()] == [27700, None]


def test_profiles_from_settings():
    cfg = SearchConfig.from_mapping(
        {
            "data_type": "postgres",
            "search_column": "name",
            "tie_break": "id",
            "display_columns": "a,b",
            "limit_results": 7,
            "echo_search_column": False,
            "unknown_key": 1,
        }
    )
    assert cfg.policy == "coalesce_sep" and cfg.limit == 7 and cfg.display_columns == ("a", "b")
    assert not cfg.echo_search_column


def test_multi_search(spark, table):
    other = spark.createDataFrame([(10, "Redwood")], "k long, title string")
    cfg2 = SearchConfig(name="other", search_column="title", tie_break=("k",), extra_columns=("k",))
    out = multi_search([(CFG.replace(name="t", limit=2), table), (cfg2, other)], "red w")
    rows = [(r.config_name, r.extra) for r in out.collect()]
    assert sorted(rows) == [("other", '{"k":10}'), ("t", '{"id":1}'), ("t", '{"id":6}')]


def test_plan_pushes_projection_and_uses_topk(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    df = spark.read.parquet(path)
    plan = search(df, "red w", CFG.replace(display_columns=())).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "brand" not in plan.split("ReadSchema")[1].split("\n")[0]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from lookout.functions.patterns import wildcard_pattern_text  # noqa: E402
from lookout.operators.search import match_condition, ordered_parts  # noqa: E402

_ALPHA = "abAB %\\_İıΣσς"


@settings(max_examples=20, deadline=None)
@given(
    st.lists(st.text(_ALPHA, max_size=10), min_size=1, max_size=25),
    st.lists(st.text("abAB%\\ İΣ", min_size=3, max_size=8), min_size=1, max_size=4),
    st.booleans(),
    st.booleans(),
)
def test_ordered_locate_chain_equals_like(spark, texts, queries, escape, case_sensitive):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for q in queries:
        pattern = wildcard_pattern_text(q, escape=escape)
        ours = match_condition("t", pattern, case_sensitive)
        plain = F.col("t").like(pattern) if case_sensitive else F.col("t").ilike(pattern)
        got = {r.i for r in df.where(ours).collect()}
        want = {r.i for r in df.where(plain).collect()}
        assert got == want, (pattern, ordered_parts(pattern))


def test_tree_top_k_on_wide_input(spark):
    from lookout.operators.search import top_k

    df = spark.range(0, 20000).select((F.col("id") * 7919 % 20011).alias("v"), F.col("id")).repartition(200)
    order = [F.col("v").asc(), F.col("id").asc()]
    tree = top_k(df, order, 50)
    plan = tree._jdf.queryExecution().executedPlan().toString().lower()
    assert "windowgrouplimit" in plan and "spark_partition_id" in plan
    want = [tuple(r) for r in df.orderBy(*order).limit(50).collect()]
    assert [tuple(r) for r in tree.collect()] == want
    assert [tuple(r) for r in top_k(df.coalesce(2), order, 50).collect()] == want


def test_any_rows_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id AS k", "'ring' AS name")
    for mode in ("any_n", "unordered"):
        cfg = SearchConfig(search_column="name", tie_break="k", extra_columns="k", limit=3, limit_mode=mode)
        for parts in (2, 70):
            assert {r.k for r in search(df.repartition(parts), "ring", cfg).collect()} == {0, 1, 2}


def test_planning_a_search_runs_no_job(spark):
    df = spark.range(100).selectExpr("id % 7 AS k", "'ring' AS name").groupBy("k", "name").count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "planning")
    search(df, "ring", SearchConfig(search_column="name", tie_break="k", limit=3))
    assert list(tracker.getJobIdsForGroup("plan-only")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_limits_that_are_no_numbers():
    from lookout.functions.patterns import resolve_limit

    for bad in ("lots", "nan", "inf", float("nan")):
        assert resolve_limit(bad) == 1000 and resolve_limit(bad, "unordered") is None
    assert resolve_limit("12.0") == 12 and resolve_limit(0, "unordered") is None and resolve_limit(0) == 0


def test_multi_search_without_extra_columns(spark):
    a = spark.createDataFrame([(1, "red ring")], "k long, name string")
    cfg = SearchConfig(name="a", search_column="name", tie_break="k")
    rows = multi_search([(cfg, a)], "red").collect()
    assert [(r.config_name, r.suggestion, r.extra) for r in rows] == [("a", "red ring", "{}")]
