"""Inputs derived from the driver's tables (FIXTURES.md).

The reference ships no data; these relations are computed by Spark from the
given parquet tables, so every registered query grows with them.  Each
derivation is written once as SQL expression text and used both by Spark
(``selectExpr``) and by the DuckDB oracle (``places_sql``), so the two sides
read the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- places
# A searchable relation with geometry, one row per customer.  Integer
# coordinates keep the text form of every number identical in both engines.

_PLACE_BASE = [
    ("place_id", "c_custkey"),
    ("name", "c_name"),
    ("c_mktsegment", "c_mktsegment"),
    ("c_nationkey", "c_nationkey"),
    ("lon", "CAST(c_custkey * 37 % 360 - 180 AS INT)"),
    ("lat", "CAST(c_custkey * 53 % 170 - 85 AS INT)"),
]

_S = "CAST({} AS STRING)"


def _num(expr: str) -> str:
    return _S.format(expr)


_PLACE_DERIVED = [
    ("place_id", "place_id"),
    ("name", "name"),
    ("context1", "CASE WHEN place_id % 7 = 0 THEN NULL WHEN place_id % 7 = 1 THEN '' ELSE c_mktsegment END"),
    ("context2", "CASE WHEN place_id % 5 = 0 THEN NULL ELSE c_nationkey END"),
    ("lon", "lon"),
    ("lat", "lat"),
    (
        "geom",
        "CASE place_id % 6 "
        f"WHEN 0 THEN 'POINT (' || {_num('lon')} || ' ' || {_num('lat')} || ')' "
        f"WHEN 1 THEN 'LINESTRING (' || {_num('lon')} || ' ' || {_num('lat')} || ', ' || {_num('lon + 2')} || ' ' "
        f"|| {_num('lat + 1')} || ', ' || {_num('lon + 3')} || ' ' || {_num('lat + 3')} || ')' "
        f"WHEN 2 THEN 'POLYGON ((' || {_num('lon')} || ' ' || {_num('lat')} || ', ' || {_num('lon + 4')} || ' ' "
        f"|| {_num('lat')} || ', ' || {_num('lon + 4')} || ' ' || {_num('lat + 2')} || ', ' || {_num('lon')} || ' ' "
        f"|| {_num('lat + 2')} || ', ' || {_num('lon')} || ' ' || {_num('lat')} || '))' "
        f"WHEN 3 THEN 'LINESTRING (' || {_num('lon')} || ' ' || {_num('lat')} || ', ' || {_num('lon + 5')} || ' ' "
        f"|| {_num('lat')} || ')' "
        "WHEN 4 THEN NULL "
        "ELSE 'GEOMETRYCOLLECTION EMPTY' END",
    ),
    ("epsg", "4326"),
    ("authid", "CASE WHEN place_id % 11 = 0 THEN 'USER:100001' ELSE 'EPSG:4326' END"),
    (
        "bbox_text",
        "CASE place_id % 8 "
        f"WHEN 0 THEN {_num('lon - 1')} || ',' || {_num('lat - 1')} || ',' || {_num('lon + 1')} || ',' || {_num('lat + 1')} "
        "WHEN 1 THEN NULL "
        "WHEN 2 THEN '' "
        f"WHEN 3 THEN {_num('lon')} || ',' || {_num('lat')} || ',' || {_num('lon + 1')} "
        f"WHEN 4 THEN {_num('lon')} || ',' || {_num('lat')} || ',x,' || {_num('lat + 1')} "
        f"WHEN 5 THEN ' ' || {_num('lon - 2')} || ' , ' || {_num('lat - 2')} || ' , ' || {_num('lon + 2')} || ' , ' "
        f"|| {_num('lat + 2')} || ' ' "
        f"WHEN 6 THEN {_num('lon + 1')} || ',' || {_num('lat + 1')} || ',' || {_num('lon - 1')} || ',' || {_num('lat - 1')} "
        f"ELSE {_num('lon - 1')} || ',' || {_num('lat - 1')} || ',' || {_num('lon + 2')} || ',' || {_num('lat + 3')} END",
    ),
]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``places`` relation (FIXTURES.md) derived from ``customer``."""
    base = load(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {a}" for a, e in _PLACE_BASE])
    out = base.selectExpr(*[f"{e} AS {a}" for a, e in _PLACE_DERIVED])
    return out.withColumn("epsg", F.col("epsg").cast("int")).withColumn("context2", F.col("context2").cast("int"))


def places_sql() -> str:
    """The same relation as DuckDB SQL (for oracles)."""
    base = ", ".join(f"{e} AS {a}" for a, e in _PLACE_BASE)
    derived = ", ".join(f"{e} AS {a}" for a, e in _PLACE_DERIVED)
    derived = derived.replace("4326 AS epsg", "CAST(4326 AS INTEGER) AS epsg")
    return f"(SELECT {derived} FROM (SELECT {base} FROM customer) b)"


# --------------------------------------------------------------------------- search strings
# The edge-case search strings of FIXTURES.md (B15), in order.
EDGE_QUERIES = [
    (1, "red w", 5),
    (2, "RING", 5),
    (3, "   ", 5),
    (4, "zz", 5),
    (5, "a_b", 5),
    (6, "100%", 5),
    (7, "hot  plate", 5),
    (8, "ring\\", 5),
]


def edge_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_QUERIES, "query_id int, text string, k int")


def edge_queries_sql() -> str:
    rows = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}', {k})" for i, t, k in EDGE_QUERIES)
    return f"(SELECT * FROM (VALUES {rows}) v(query_id, text, k))"


# Customer look-up strings: "Customer#000000042" typed as "customer 000000042",
# one per customer row, so the query set grows with the table.
CUSTOMER_QUERY_EXPR = "lower(replace(c_name, '#', ' '))"


def customer_queries(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS query_id", f"{CUSTOMER_QUERY_EXPR} AS text", f"CAST({k} AS INT) AS k"
    )


def customer_queries_sql(k: int = 3) -> str:
    return f"(SELECT CAST(c_custkey AS BIGINT) AS query_id, {CUSTOMER_QUERY_EXPR} AS text, CAST({k} AS INTEGER) AS k FROM customer)"


# --------------------------------------------------------------------------- keystrokes
# Keystroke stream from ``events``: one session per user, the event type is the
# typed text.


def keystrokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("ts"),
        F.col("event_id"),
        F.col("event_type").alias("text"),
    )


KEYSTROKES_SQL = "(SELECT user_id AS session_id, ts, event_id, event_type AS text FROM events)"

# Place-name keystrokes: every event types "cust <n>" with n from its value,
# so the debounced texts hit ``places`` names.
NAME_TEXT_EXPR = "'cust ' || CAST(CAST(floor(value) AS INT) AS STRING)"


def name_keystrokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(
        "user_id AS session_id", "ts", "event_id", f"{NAME_TEXT_EXPR} AS text"
    )


NAME_KEYSTROKES_SQL = f"(SELECT user_id AS session_id, ts, event_id, {NAME_TEXT_EXPR} AS text FROM events)"
