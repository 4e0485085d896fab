"""Registered queries: one per operator of SURVEY §2, each with its DuckDB oracle.

Every query reads the driver's tables (or relations Spark derives from them,
see ``fixtures``) in full.  ``QUERIES[name](spark, sf_dir)`` returns a lazy
DataFrame; ``ORACLE[name]`` is ANSI SQL over the same tables with the same
column names.  Queries without an oracle are checked on row counts only.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions import geometry as G
from ..functions import transverse as T
from ..functions import viewport as V
from ..functions.collation import collation_rules
from ..functions.expressions import with_expression
from ..functions.patterns import wildcard_pattern
from ..operators import postings
from ..operators.batch import batch_search, prepare_queries
from ..operators.hits import with_geometry, with_viewport
from ..operators.search import multi_search, search
from ..session import ensure_checkpoint_dir
from ..sources.keyed import read_keyed, upsert
from ..streaming.debounce import accepted, debounce, debounce_search, latest_per_session, search_debounced
from ..streaming.stateful import debounce_batch, read_debounced, read_late
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


PLACES = X.places_sql()

# --------------------------------------------------------------------------- configs

PART = SearchConfig(
    name="part",
    search_column="p_name",
    tie_break=("p_partkey",),
    display_columns=("p_brand", "p_type"),
    extra_columns=("p_partkey",),
)

PLACE = SearchConfig(
    name="places",
    search_column="name",
    tie_break=("place_id",),
    display_columns=("context1", "context2"),
    geom_column="geom",
    srid="epsg",
    extra_columns=("place_id",),
)

# DuckDB text for the suggestion policies over places (display context1, context2).
_SKIP_FALSY = "concat_ws(', ', name, CASE WHEN context1 <> '' THEN context1 END, CAST(context2 AS STRING))"
_PART_LINE = "concat_ws(', ', p_name, CASE WHEN p_brand <> '' THEN p_brand END, CASE WHEN p_type <> '' THEN p_type END)"
_NULL_GEOM = "CAST(NULL AS STRING) AS geom, CAST(NULL AS INTEGER) AS epsg"


def _part(spark, d):
    return X.load(spark, d, "part")


# --------------------------------------------------------------------------- B1-B14 single search


@register(
    "search_basic",
    f"""SELECT {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey FROM part
        WHERE CAST(p_name AS STRING) ILIKE '%red%w%' ESCAPE '\\'
        ORDER BY p_name, p_partkey LIMIT 1000""",
)
def search_basic(spark, d):
    return search(_part(spark, d), "red w", PART)


@register(
    "search_multiword",
    f"""SELECT {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey FROM part
        WHERE CAST(p_name AS STRING) ILIKE '%sm%ri%' ESCAPE '\\'
        ORDER BY p_name, p_partkey LIMIT 1000""",
)
def search_multiword(spark, d):
    return search(_part(spark, d), "  sm \t ri ", PART)


@register(
    "search_blank_text",
    f"""SELECT {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey FROM part
        WHERE CAST(p_name AS STRING) ILIKE '%' ESCAPE '\\'
        ORDER BY p_name, p_partkey LIMIT 1000""",
)
def search_blank_text(spark, d):
    return search(_part(spark, d), "   ", PART)


@register(
    "search_escaped",
    """SELECT CAST(NULL AS STRING) AS geom, CAST(NULL AS INTEGER) AS epsg, url AS suggestion, page_id FROM pages
        WHERE CAST(html AS STRING) ILIKE '%de\\%\\%\\%%' ESCAPE '\\'
        ORDER BY html, page_id LIMIT 1000""",
)
def search_escaped(spark, d):
    cfg = SearchConfig(
        search_column="html",
        tie_break=("page_id",),
        display_columns=("url",),
        echo_search_column=False,
        escape_spec_chars=True,
        extra_columns=("page_id",),
    )
    return search(X.load(spark, d, "pages"), "de%%%", cfg)


@register(
    "search_unescaped_wildcards",
    """SELECT CAST(NULL AS STRING) AS geom, CAST(NULL AS INTEGER) AS epsg, url AS suggestion, page_id FROM pages
        WHERE CAST(html AS STRING) ILIKE '%de%%%%' ESCAPE '\\'
        ORDER BY html, page_id LIMIT 1000""",
)
def search_unescaped_wildcards(spark, d):
    cfg = SearchConfig(
        search_column="html",
        tie_break=("page_id",),
        display_columns=("url",),
        echo_search_column=False,
        extra_columns=("page_id",),
    )
    return search(X.load(spark, d, "pages"), "de%%%", cfg)


@register(
    "search_backslash",
    f"""SELECT {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey FROM part
        WHERE CAST(p_name AS STRING) ILIKE '%ho%\\ring%' ESCAPE '\\'
        ORDER BY p_name, p_partkey LIMIT 1000""",
)
def search_backslash(spark, d):
    # PostgreSQL rule: a backslash escapes the next character, "\r" is "r".
    return search(_part(spark, d), "ho \\ring", PART)


_SLASHED = "replace(p_name, ' ', '\\')"


@register(
    "search_backslash_literal",
    f"""SELECT CAST(NULL AS STRING) AS geom, CAST(NULL AS INTEGER) AS epsg,
        concat_ws(', ', {_SLASHED}, p_brand, p_type) AS suggestion, p_partkey FROM part
        WHERE position('e\\r' IN lower({_SLASHED})) > 0
        ORDER BY {_SLASHED}, p_partkey LIMIT 1000""",
)
def search_backslash_literal(spark, d):
    # SQL Server rule: the backslash is an ordinary character.
    part = _part(spark, d).withColumn("p_name", F.translate("p_name", " ", "\\"))
    cfg = SearchConfig.for_profile("mssql", **{**_cfg_kwargs(PART)})
    return search(part, "e\\r", cfg)


def _cfg_kwargs(cfg: SearchConfig) -> dict:
    keep = ("name", "search_column", "tie_break", "display_columns", "geom_column", "srid", "extra_columns")
    return {k: getattr(cfg, k) for k in keep}


@register(
    "search_case_sensitive",
    f"""SELECT geom, epsg, {_SKIP_FALSY} AS suggestion, place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) LIKE '%Customer%00001%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def search_case_sensitive(spark, d):
    return search(X.places(spark, d), "Customer 00001", PLACE.replace(case_sensitive=True))


@register(
    "search_case_sensitive_miss",
    f"""SELECT geom, epsg, {_SKIP_FALSY} AS suggestion, place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) LIKE '%customer%00001%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def search_case_sensitive_miss(spark, d):
    return search(X.places(spark, d), "customer 00001", PLACE.replace(case_sensitive=True))


@register(
    "search_numeric_column",
    """SELECT CAST(NULL AS STRING) AS geom, CAST(NULL AS INTEGER) AS epsg,
        concat_ws(', ', CAST(p_partkey AS STRING), p_name) AS suggestion, p_partkey FROM part
        WHERE CAST(p_partkey AS STRING) ILIKE '%12%3%' ESCAPE '\\'
        ORDER BY p_partkey LIMIT 1000""",
)
def search_numeric_column(spark, d):
    cfg = SearchConfig(
        search_column="p_partkey", tie_break=("p_partkey",), display_columns=("p_name",), extra_columns=("p_partkey",)
    )
    return search(_part(spark, d), "12 3", cfg)


@register(
    "search_places",
    f"""SELECT geom, epsg, {_SKIP_FALSY} AS suggestion, place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%1%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def search_places(spark, d):
    return search(X.places(spark, d), "cust 1", PLACE)


@register(
    "suggest_coalesce_sep",
    f"""SELECT geom, epsg,
        name || CASE WHEN context1 IS NOT NULL THEN ', ' || context1 ELSE '' END
             || CASE WHEN context2 IS NOT NULL THEN ', ' || CAST(context2 AS STRING) ELSE '' END AS suggestion,
        place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%2%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def suggest_coalesce_sep(spark, d):
    cfg = SearchConfig.for_profile("postgres", **_cfg_kwargs(PLACE))
    return search(X.places(spark, d), "cust 2", cfg)


@register(
    "suggest_coalesce_sep_no_echo",
    f"""SELECT geom, epsg,
        '' || CASE WHEN context1 IS NOT NULL THEN context1 ELSE '' END
           || CASE WHEN context2 IS NOT NULL THEN ', ' || CAST(context2 AS STRING) ELSE '' END AS suggestion,
        place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%2%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def suggest_coalesce_sep_no_echo(spark, d):
    cfg = SearchConfig.for_profile("postgres", **_cfg_kwargs(PLACE), echo_search_column=False)
    return search(X.places(spark, d), "cust 2", cfg)


@register(
    "suggest_oracle_empty_is_null",
    f"""SELECT geom, epsg,
        NULLIF('' || CASE WHEN context1 IS NOT NULL THEN context1 ELSE '' END, '') AS suggestion,
        place_id FROM (SELECT * FROM {PLACES} p
        WHERE lower(CAST(name AS STRING)) LIKE lower('%cust%3%') ESCAPE '\\'
        ORDER BY name, place_id) s""",
)
def suggest_oracle_empty_is_null(spark, d):
    cfg = SearchConfig.for_profile(
        "oracle",
        **{**_cfg_kwargs(PLACE), "display_columns": ("context1",)},
        echo_search_column=False,
        limit=None,
    )
    return search(X.places(spark, d), "cust 3", cfg)


@register(
    "suggest_concat_all",
    f"""SELECT geom, epsg,
        concat_ws(', ', COALESCE(CAST(name AS STRING), ''), COALESCE(context1, ''),
                  COALESCE(CAST(context2 AS STRING), '')) AS suggestion,
        place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%4%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def suggest_concat_all(spark, d):
    cfg = SearchConfig.for_profile("mssql", **_cfg_kwargs(PLACE))
    return search(X.places(spark, d), "cust 4", cfg)


@register(
    "suggest_concat_all_one_column",
    f"""SELECT geom, epsg, substring(CAST(context1 AS STRING), 1, 30) AS suggestion, place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%4%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def suggest_concat_all_one_column(spark, d):
    cfg = SearchConfig.for_profile(
        "mssql", **{**_cfg_kwargs(PLACE), "display_columns": ("context1",)}, echo_search_column=False, truncate30=True
    )
    return search(X.places(spark, d), "cust 4", cfg)


@register(
    "suggest_skip_falsy",
    f"""SELECT geom, epsg, {_SKIP_FALSY} AS suggestion, place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%5%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def suggest_skip_falsy(spark, d):
    return search(X.places(spark, d), "cust 5", PLACE)


@register(
    "suggest_skip_falsy_drop_zero",
    f"""SELECT geom, epsg,
        concat_ws(', ', name, CASE WHEN context1 <> '' THEN context1 END,
                  CASE WHEN context2 <> 0 THEN CAST(context2 AS STRING) END) AS suggestion,
        place_id FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%5%' ESCAPE '\\'""",
)
def suggest_skip_falsy_drop_zero(spark, d):
    cfg = SearchConfig.for_profile("gpkg", **_cfg_kwargs(PLACE), limit=0)
    return search(X.places(spark, d), "cust 5", cfg)


@register(
    "search_extra_missing",
    f"""SELECT geom, epsg, {_SKIP_FALSY} AS suggestion, place_id, '' AS no_such_column FROM {PLACES} p
        WHERE CAST(name AS STRING) ILIKE '%cust%6%' ESCAPE '\\'
        ORDER BY name, place_id LIMIT 1000""",
)
def search_extra_missing(spark, d):
    cfg = PLACE.replace(extra_columns=("place_id", "no_such_column", "place_id"), on_missing_extra="empty")
    return search(X.places(spark, d), "cust 6", cfg)


@register(
    "search_topk",
    f"""SELECT {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey FROM part
        WHERE CAST(p_name AS STRING) ILIKE '%o%' ESCAPE '\\'
        ORDER BY p_name, p_partkey LIMIT 10""",
)
def search_topk(spark, d):
    return search(_part(spark, d), "o  ", PART.replace(limit=10))


@register(
    "search_limit_not_number",
    f"""SELECT {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey FROM part
        WHERE CAST(p_name AS STRING) ILIKE '%e%' ESCAPE '\\'
        ORDER BY p_name, p_partkey LIMIT 1000""",
)
def search_limit_not_number(spark, d):
    return search(_part(spark, d), "e  ", PART.replace(limit="lots"))


@register(
    "search_any_n",
    f"""SELECT {_NULL_GEOM}, p_name || ', ' || p_brand || ', ' || p_type AS suggestion, p_partkey
        FROM (SELECT * FROM part WHERE p_name ILIKE '%red%' ORDER BY p_partkey LIMIT 25) x""",
)
def search_any_n(spark, d):
    cfg = SearchConfig.for_profile("oracle", **_cfg_kwargs(PART), limit=25)
    return search(_part(spark, d), "red", cfg)


@register(
    "search_unordered",
    f"""SELECT {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey
        FROM (SELECT * FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_partkey LIMIT 25) x""",
)
def search_unordered(spark, d):
    cfg = SearchConfig.for_profile("gpkg", **_cfg_kwargs(PART), limit=25)
    return search(_part(spark, d), "ring", cfg)


@register(
    "search_min_length",
    """SELECT CAST(c_custkey AS BIGINT) AS query_id,
        CASE WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) = 0 THEN '%'
             ELSE '%' || array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''), '%') || '%' END
          AS pattern,
        CAST(1000 AS INTEGER) AS k
        FROM (SELECT c_custkey, substring(c_mktsegment, 1, CAST(c_custkey % 5 AS INTEGER)) || ' '
                     || substring(c_name, 10, CAST(c_custkey % 3 AS INTEGER)) AS t FROM customer) s
        WHERE length(t) >= 3""",
)
def search_min_length(spark, d):
    texts = X.load(spark, d, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS query_id",
        "substring(c_mktsegment, 1, CAST(c_custkey % 5 AS INT)) || ' ' "
        "|| substring(c_name, 10, CAST(c_custkey % 3 AS INT)) AS text",
    )
    return prepare_queries(texts, PART, k_col=None)


@register(
    "search_collation",
    """SELECT CAST(NULL AS STRING) AS geom, CAST(NULL AS INTEGER) AS epsg, lang AS suggestion, doc_id
        FROM (SELECT * FROM documents WHERE CAST(text AS STRING) ILIKE '%the%and%' ESCAPE '\\'
              ORDER BY lower(text), doc_id LIMIT 25) s""",
)
def search_collation(spark, d):
    cfg = SearchConfig(
        search_column="text",
        tie_break=("doc_id",),
        display_columns=("lang",),
        echo_search_column=False,
        extra_columns=("doc_id",),
        collation="UTF8_LCASE",
        limit=25,
    )
    return search(X.load(spark, d, "documents"), "the and", cfg)


DOCS = SearchConfig(
    name="documents",
    search_column="text",
    tie_break=("doc_id",),
    display_columns=("lang", "source"),
    echo_search_column=False,
    extra_columns=("doc_id",),
)
_DOC_LINE = "concat_ws(', ', CASE WHEN lang <> '' THEN lang END, CASE WHEN source <> '' THEN source END)"


@register(
    "search_documents",
    f"""SELECT {_NULL_GEOM}, {_DOC_LINE} AS suggestion, doc_id FROM documents
        WHERE CAST(text AS STRING) ILIKE '%the%and%of%' ESCAPE '\\'
        ORDER BY text, doc_id LIMIT 1000""",
)
def search_documents(spark, d):
    return search(X.load(spark, d, "documents"), "the and of", DOCS)


# --------------------------------------------------------------------------- B15 batch search

_BATCH_PART_SQL = f"""
WITH q AS (
  SELECT query_id, k,
    CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) = 0 THEN '%'
         ELSE '%' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), '%') || '%' END
      AS pattern
  FROM {X.edge_queries_sql()} e WHERE length(text) >= 3
), pat AS (
  SELECT query_id, k,
    regexp_replace(pattern, '(\\\\[%_\\\\])|\\\\(.)', '\\1\\2', 'g') AS pattern FROM q
), hits AS (
  SELECT pat.query_id, pat.k, p.*,
    row_number() OVER (PARTITION BY pat.query_id ORDER BY p.p_name, p.p_partkey) AS rank
  FROM pat JOIN part p ON CAST(p.p_name AS STRING) ILIKE pat.pattern ESCAPE '\\'
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey
FROM hits WHERE rank <= k
"""


@register("batch_search", _BATCH_PART_SQL)
def batch_search_scan(spark, d):
    return batch_search(_part(spark, d), X.edge_queries(spark), PART, strategy="scan")


@register("batch_search_blocked", _BATCH_PART_SQL)
def batch_search_blocked(spark, d):
    return batch_search(_part(spark, d), X.edge_queries(spark), PART, strategy="blocked")


def _batch_part_sql(case_sensitive: bool, escape: bool) -> str:
    op = "LIKE" if case_sensitive else "ILIKE"
    part = "regexp_replace(x, '([\\\\%_])', '\\\\\\1', 'g')" if escape else "x"
    normalise = "pattern" if escape else "regexp_replace(pattern, '(\\\\[%_\\\\])|\\\\(.)', '\\1\\2', 'g')"
    return f"""
WITH q AS (
  SELECT query_id, k,
    '%' || array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''),
                                          lambda x: {part}), '%') AS body
  FROM {X.edge_queries_sql()} e WHERE length(text) >= 3
), pat AS (
  SELECT query_id, k, CASE WHEN body = '%' THEN '%' ELSE body || '%' END AS pattern FROM q
), norm AS (
  SELECT query_id, k, {normalise} AS pattern FROM pat
), hits AS (
  SELECT norm.query_id, norm.k, p.*,
    row_number() OVER (PARTITION BY norm.query_id ORDER BY p.p_name, p.p_partkey) AS rank
  FROM norm JOIN part p ON CAST(p.p_name AS STRING) {op} norm.pattern ESCAPE '\\'
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey
FROM hits WHERE rank <= k
"""


@register("batch_search_case_sensitive", _batch_part_sql(True, False))
def batch_search_case_sensitive(spark, d):
    return batch_search(_part(spark, d), X.edge_queries(spark), PART.replace(case_sensitive=True), strategy="blocked")


@register("batch_search_escaped", _batch_part_sql(False, True))
def batch_search_escaped(spark, d):
    return batch_search(_part(spark, d), X.edge_queries(spark), PART.replace(escape_spec_chars=True), strategy="blocked")


@register(
    "batch_unlimited",
    f"""SELECT query_id, CAST(NULL AS INTEGER) AS rank, {_NULL_GEOM}, {_PART_LINE} AS suggestion, p_partkey
        FROM (SELECT CAST(p_partkey AS BIGINT) AS query_id, p_type AS t FROM part) q
        JOIN part p ON contains(lower(p.p_type || ' ' || p.p_name), lower(q.t))""",
)
def batch_unlimited(spark, d):
    """No limit anywhere (DEC-9): every hit of every query."""
    part = _part(spark, d).withColumn("line", F.concat_ws(" ", "p_type", "p_name"))
    queries = _part(spark, d).selectExpr("CAST(p_partkey AS BIGINT) AS query_id", "p_type AS text")
    cfg = PART.replace(search_column="line", display_columns=("p_name", "p_brand", "p_type"), echo_search_column=False, limit=None)
    return batch_search(part, queries, cfg, strategy="blocked", k_col=None)


_GEOCODE_SQL = f"""
WITH q AS (
  SELECT query_id, k,
    '%' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), '%') || '%' AS pattern
  FROM {X.customer_queries_sql(3)} c
), hits AS (
  SELECT q.query_id, q.k, p.*,
    row_number() OVER (PARTITION BY q.query_id ORDER BY p.name, p.place_id) AS rank
  FROM q JOIN {PLACES} p ON CAST(p.name AS STRING) ILIKE q.pattern ESCAPE '\\'
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, geom, epsg, {_SKIP_FALSY} AS suggestion, place_id
FROM hits WHERE rank <= k
"""


@register("batch_geocode", _GEOCODE_SQL)
def batch_geocode(spark, d):
    return batch_search(X.places(spark, d), X.customer_queries(spark, d, 3), PLACE, strategy="blocked")


_PART_NAME_QUERIES = "(SELECT CAST(p_partkey AS BIGINT) AS query_id, p_name AS text, CAST(3 AS INTEGER) AS k FROM part)"


@register(
    "batch_search_documents",
    f"""
WITH q AS (
  SELECT query_id, k,
    lower('%' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), '%') || '%')
      AS pattern
  FROM {_PART_NAME_QUERIES} s
), pat AS (SELECT DISTINCT pattern FROM q),
hits AS (
  SELECT pat.pattern, d.doc_id, d.lang, d.source,
    row_number() OVER (PARTITION BY pat.pattern ORDER BY d.text, d.doc_id) AS rank
  FROM pat JOIN documents d ON CAST(d.text AS STRING) ILIKE pat.pattern ESCAPE '\\'
)
SELECT q.query_id, CAST(h.rank AS INTEGER) AS rank, {_NULL_GEOM},
       concat_ws(', ', CASE WHEN h.lang <> '' THEN h.lang END, CASE WHEN h.source <> '' THEN h.source END) AS suggestion,
       h.doc_id
FROM q JOIN hits h ON q.pattern = h.pattern WHERE h.rank <= q.k
""",
)
def batch_search_documents(spark, d):
    queries = _part(spark, d).selectExpr("CAST(p_partkey AS BIGINT) AS query_id", "p_name AS text", "CAST(3 AS INT) AS k")
    return batch_search(X.load(spark, d, "documents"), queries, DOCS, strategy="blocked")


_ACCENT_TEXTS = [(1, "Ésta", 5), (2, "gäte", 4), (3, "cion es", 5), (4, "NÃO", 3), (5, "é_a", 5), (6, "für die", 6)]


@register(
    "search_accent_insensitive",
    f"""SELECT {_NULL_GEOM}, {_DOC_LINE} AS suggestion, doc_id FROM documents
        WHERE strip_accents(text) ILIKE '%cion%es%' ESCAPE '\\'
        ORDER BY text, doc_id LIMIT 1000""",
)
def search_accent_insensitive(spark, d):
    return search(X.load(spark, d, "documents"), "ción És", DOCS.replace(**collation_rules("Latin1_General_CI_AI")))


@register(
    "batch_search_accent_insensitive",
    f"""
WITH q AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, '%{unicodedata.normalize('NFD', t).encode('ascii', 'ignore').decode().replace(' ', '%')}%', {k})" for i, t, k in _ACCENT_TEXTS)}) v(query_id, pattern, k)
), hits AS (
  SELECT q.query_id, q.k, d.*, row_number() OVER (PARTITION BY q.query_id ORDER BY d.text, d.doc_id) AS rank
  FROM q JOIN documents d ON strip_accents(d.text) ILIKE q.pattern ESCAPE '\\'
)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, {_NULL_GEOM}, {_DOC_LINE} AS suggestion, doc_id
FROM hits WHERE rank <= k""",
)
def batch_search_accent_insensitive(spark, d):
    queries = spark.createDataFrame(_ACCENT_TEXTS, "query_id long, text string, k int")
    cfg = DOCS.replace(**collation_rules("Latin1_General_CI_AI"))
    return batch_search(X.load(spark, d, "documents"), queries, cfg, strategy="blocked")


# --------------------------------------------------------------------------- searches served by an n-gram index


def _document_index(spark, d, rows_per_part=1000):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lookout-index-{uuid.uuid4().hex}"
    return postings.build(X.load(spark, d, "documents"), DOCS, path, rows_per_part=rows_per_part)


@register(
    "search_indexed",
    f"""SELECT {_NULL_GEOM}, {_DOC_LINE} AS suggestion, doc_id FROM documents
        WHERE CAST(text AS STRING) ILIKE '%quer%ion%' ESCAPE '\\'
        ORDER BY text, doc_id LIMIT 1000""",
)
def search_indexed(spark, d):
    return postings.search_indexed(_document_index(spark, d), "quer ion", DOCS)


@register("batch_search_indexed", ORACLE["batch_search_documents"])
def batch_search_indexed(spark, d):
    queries = _part(spark, d).selectExpr("CAST(p_partkey AS BIGINT) AS query_id", "p_name AS text", "CAST(3 AS INT) AS k")
    return postings.batch_search_indexed(_document_index(spark, d), queries, DOCS)


# --------------------------------------------------------------------------- B16 multi-config


def _multi_sources(spark, d):
    nation = SearchConfig(
        name="nation", search_column="n_name", tie_break=("n_nationkey",), extra_columns=("n_nationkey",), limit=5
    )
    supplier = SearchConfig(
        name="supplier",
        search_column="s_name",
        tie_break=("s_suppkey",),
        display_columns=("s_nationkey",),
        extra_columns=("s_suppkey",),
        limit=5,
    )
    return [
        (PART.replace(limit=5), _part(spark, d)),
        (nation, X.load(spark, d, "nation")),
        (supplier, X.load(spark, d, "supplier")),
        (PLACE.replace(limit=5), X.places(spark, d)),
    ]


_NO_VIEW = "CAST(2000 AS DOUBLE) AS scale_denom, CAST(NULL AS STRING) AS bbox_text"


@register(
    "multi_config",
    f"""
(SELECT 'part' AS config_name, {_NULL_GEOM}, {_PART_LINE} AS suggestion,
        '{{"p_partkey":' || CAST(p_partkey AS STRING) || '}}' AS extra, {_NO_VIEW}
 FROM part WHERE CAST(p_name AS STRING) ILIKE '%r%1%' ESCAPE '\\' ORDER BY p_name, p_partkey LIMIT 5)
UNION ALL
(SELECT 'nation', {_NULL_GEOM}, n_name, '{{"n_nationkey":' || CAST(n_nationkey AS STRING) || '}}', {_NO_VIEW}
 FROM nation WHERE CAST(n_name AS STRING) ILIKE '%r%1%' ESCAPE '\\' ORDER BY n_name, n_nationkey LIMIT 5)
UNION ALL
(SELECT 'supplier', {_NULL_GEOM}, concat_ws(', ', s_name, CAST(s_nationkey AS STRING)),
        '{{"s_suppkey":' || CAST(s_suppkey AS STRING) || '}}', {_NO_VIEW}
 FROM supplier WHERE CAST(s_name AS STRING) ILIKE '%r%1%' ESCAPE '\\' ORDER BY s_name, s_suppkey LIMIT 5)
UNION ALL
(SELECT 'places', geom, epsg, {_SKIP_FALSY}, '{{"place_id":' || CAST(place_id AS STRING) || '}}', {_NO_VIEW}
 FROM {PLACES} p WHERE CAST(name AS STRING) ILIKE '%r%1%' ESCAPE '\\' ORDER BY name, place_id LIMIT 5)
""",
)
def multi_config(spark, d):
    return multi_search(_multi_sources(spark, d), "r 1")


# Settings rows as the reference stores them (key names, comma lists), one per config.
_SETTINGS = [
    {
        "name": "places",
        "data_type": "postgres",
        "search_column": "name",
        "tie_break": "place_id",
        "display_columns": "context1,context2",
        "geom_column": "geom",
        "srid": "epsg",
        "extra_columns": "place_id",
        "echo_search_column": True,
        "limit_results": 4,
    },
    {
        "name": "part",
        "data_type": "mssql",
        "search_column": "p_name",
        "tie_break": "p_partkey",
        "display_columns": "p_brand",
        "extra_columns": "p_partkey",
        "echo_search_column": "false",
        "limit_results": "not a number",
    },
]


@register(
    "multi_config_settings",
    f"""
(SELECT 'places' AS config_name, geom, epsg,
        name || CASE WHEN context1 IS NOT NULL THEN ', ' || context1 ELSE '' END
             || CASE WHEN context2 IS NOT NULL THEN ', ' || CAST(context2 AS STRING) ELSE '' END AS suggestion,
        '{{"place_id":' || CAST(place_id AS STRING) || '}}' AS extra, {_NO_VIEW}
 FROM {PLACES} p WHERE CAST(name AS STRING) ILIKE '%o%e%' ESCAPE '\\' ORDER BY name, place_id LIMIT 4)
UNION ALL
(SELECT 'part', {_NULL_GEOM}, CAST(p_brand AS STRING), '{{"p_partkey":' || CAST(p_partkey AS STRING) || '}}', {_NO_VIEW}
 FROM part WHERE CAST(p_name AS STRING) ILIKE '%o%e%' ESCAPE '\\' ORDER BY p_name, p_partkey LIMIT 1000)
""",
)
def multi_config_settings(spark, d):
    frames = {"places": X.places(spark, d), "part": _part(spark, d)}
    sources = []
    for row in _SETTINGS:
        cfg = SearchConfig.from_mapping(row)
        sources.append((cfg.replace(data_type="dataframe"), frames[cfg.name]))
    return multi_search(sources, "o e")


@register(
    "multi_config_viewport",
    f"""SELECT 'places' AS config_name, CAST(place_id AS BIGINT) AS place_id,
        COALESCE(CAST(context2 * 1000 AS DOUBLE), CAST(2000 AS DOUBLE)) AS scale_denom, bbox_text
        FROM (SELECT * FROM {PLACES} p WHERE CAST(name AS STRING) ILIKE '%o%e%' ESCAPE '\\' ORDER BY name, place_id LIMIT 50) x
        UNION ALL
        SELECT 'plain', CAST(place_id AS BIGINT), CAST(2000 AS DOUBLE), CAST(NULL AS STRING)
        FROM (SELECT * FROM {PLACES} p WHERE CAST(name AS STRING) ILIKE '%o%e%' ESCAPE '\\' ORDER BY name, place_id LIMIT 7) y""",
)
def multi_config_viewport(spark, d):
    """Every config's own scale and box expressions survive the union."""
    scaled = PLACE.replace(scale_expr="context2 * 1000", bbox_expr="bbox_text", limit=50)
    places = X.places(spark, d)
    hits = multi_search([(scaled, places), (PLACE.replace(name="plain", limit=7), places)], "o e")
    place_id = F.get_json_object("extra", "$.place_id").cast("long")
    return hits.select("config_name", place_id.alias("place_id"), "scale_denom", "bbox_text")


# --------------------------------------------------------------------------- C debounce

_GAP = "2 hours"
_DEBOUNCE_SQL = f"""
SELECT session_id, ts, event_id, text FROM (
  SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS next_ts
  FROM {X.KEYSTROKES_SQL} k WHERE length(text) >= 3
) s WHERE next_ts IS NULL OR next_ts > ts + INTERVAL '{_GAP}'
"""


@register("debounce_events", _DEBOUNCE_SQL)
def debounce_events(spark, d):
    return debounce(X.keystrokes(spark, d), _GAP)


@register(
    "latest_per_session",
    f"""SELECT session_id, max(ts) AS ts, arg_max(text, (ts, event_id)) AS text
        FROM ({_DEBOUNCE_SQL}) x GROUP BY session_id""",
)
def latest_per_session_q(spark, d):
    return latest_per_session(debounce(X.keystrokes(spark, d), _GAP))


_NAME_DEBOUNCE_SQL = _DEBOUNCE_SQL.replace(X.KEYSTROKES_SQL, X.NAME_KEYSTROKES_SQL)


@register(
    "debounce_search",
    f"""
WITH deb AS ({_NAME_DEBOUNCE_SQL}),
pat AS (
  SELECT DISTINCT lower('%' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), '%')
         || '%') AS pattern FROM deb
),
hits AS (
  SELECT pat.pattern, p.*, row_number() OVER (PARTITION BY pat.pattern ORDER BY p.name, p.place_id) AS rank
  FROM pat JOIN {PLACES} p ON CAST(p.name AS STRING) ILIKE pat.pattern ESCAPE '\\'
)
SELECT deb.session_id, deb.event_id, deb.ts, deb.text, CAST(h.rank AS INTEGER) AS rank, h.geom, h.epsg,
       concat_ws(', ', h.name, CASE WHEN h.context1 <> '' THEN h.context1 END, CAST(h.context2 AS STRING)) AS suggestion,
       h.place_id
FROM deb JOIN hits h
  ON lower('%' || array_to_string(list_filter(regexp_split_to_array(deb.text, '\\s+'), lambda x: x <> ''), '%') || '%')
     = h.pattern
WHERE h.rank <= 3
""",
)
def debounce_search_q(spark, d):
    return debounce_search(X.name_keystrokes(spark, d), X.places(spark, d), PLACE.replace(limit=3), _GAP)


@register(
    "debounce_search_unlimited",
    f"""
WITH deb AS ({_NAME_DEBOUNCE_SQL}),
pat AS (
  SELECT DISTINCT lower('%' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), '%')
         || '%') AS pattern FROM deb
),
hits AS (
  SELECT pat.pattern, p.*, row_number() OVER (PARTITION BY pat.pattern ORDER BY p.name, p.place_id) AS rank
  FROM pat JOIN {PLACES} p ON CAST(p.name AS STRING) ILIKE pat.pattern ESCAPE '\\'
)
SELECT deb.session_id, deb.event_id, deb.ts, deb.text, CAST(NULL AS INTEGER) AS rank, h.geom, h.epsg,
       concat_ws(', ', h.name, CASE WHEN h.context1 <> '' THEN h.context1 END, CAST(h.context2 AS STRING)) AS suggestion,
       h.place_id
FROM deb JOIN hits h
  ON lower('%' || array_to_string(list_filter(regexp_split_to_array(deb.text, '\\s+'), lambda x: x <> ''), '%') || '%')
     = h.pattern
""",
)
def debounce_search_unlimited_q(spark, d):
    return debounce_search(X.name_keystrokes(spark, d), X.places(spark, d), PLACE.replace(limit=None), _GAP)


_REPEATED_SQL = _NAME_DEBOUNCE_SQL.replace(X.NAME_KEYSTROKES_SQL, X.NAME_KEYSTROKES_SQL.replace(" event_id,", " event_id % 1000 AS event_id,"))


@register(
    "debounce_search_repeated_ids",
    f"""
WITH deb AS ({_REPEATED_SQL}),
pat AS (
  SELECT DISTINCT lower('%' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), '%')
         || '%') AS pattern FROM deb
),
hits AS (
  SELECT pat.pattern, p.*, row_number() OVER (PARTITION BY pat.pattern ORDER BY p.name, p.place_id) AS rank
  FROM pat JOIN {PLACES} p ON CAST(p.name AS STRING) ILIKE pat.pattern ESCAPE '\\'
)
SELECT deb.session_id, deb.event_id, deb.ts, deb.text, CAST(h.rank AS INTEGER) AS rank, h.geom, h.epsg,
       concat_ws(', ', h.name, CASE WHEN h.context1 <> '' THEN h.context1 END, CAST(h.context2 AS STRING)) AS suggestion,
       h.place_id
FROM deb JOIN hits h
  ON lower('%' || array_to_string(list_filter(regexp_split_to_array(deb.text, '\\s+'), lambda x: x <> ''), '%') || '%')
     = h.pattern
WHERE h.rank <= 3
""",
)
def debounce_search_repeated_ids_q(spark, d):
    """Event ids that repeat across sessions."""
    events = X.name_keystrokes(spark, d).withColumn("event_id", F.col("event_id") % 1000)
    return debounce_search(events, X.places(spark, d), PLACE.replace(limit=3), _GAP)


_NULL_SESSIONS = "(SELECT CASE WHEN user_id % 3 <> 0 THEN user_id END AS session_id, ts, event_id, event_type AS text FROM events)"


@register("debounce_null_sessions", _DEBOUNCE_SQL.replace(X.KEYSTROKES_SQL, _NULL_SESSIONS).replace(_GAP, "1 minute 30 seconds"))
def debounce_null_sessions_q(spark, d):
    """Null sessions are one session, a third of all events."""
    events = X.keystrokes(spark, d).withColumn("session_id", F.expr("CASE WHEN session_id % 3 <> 0 THEN session_id END"))
    return debounce(events, "1 minute 30 seconds")


# Three deliveries: a fifth of the sessions comes last, whatever its time, the others by time.
_DELIVERY = """CASE WHEN user_id % 5 = 0 THEN 2 WHEN ts < TIMESTAMP '2024-01-12 00:00:00' THEN 0
    WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 1 ELSE 2 END"""
_DELAY = "12 days"
_DELIVERED_SQL = f"""
events_in AS (SELECT user_id AS session_id, ts, event_id, event_type AS text, {_DELIVERY} AS batch_id FROM events
              WHERE length(event_type) >= 3 AND ts IS NOT NULL),
marks AS (SELECT max(CASE WHEN batch_id < 1 THEN ts END) - INTERVAL '{_DELAY}' AS w1,
                 max(CASE WHEN batch_id < 2 THEN ts END) - INTERVAL '{_DELAY}' AS w2 FROM events_in),
marked AS (SELECT e.*, coalesce(CASE batch_id WHEN 1 THEN ts < w1 WHEN 2 THEN ts < w2 END, FALSE) AS late
           FROM events_in e, marks)
"""


def _deliveries(spark, d):
    events = X.load(spark, d, "events").withColumn("batch_id", F.expr(_DELIVERY))
    rows = events.selectExpr("user_id AS session_id", "ts", "event_id", "event_type AS text", "batch_id")
    return [rows.where(F.col("batch_id") == k).drop("batch_id") for k in range(3)]


def _scratch_table(spark, what):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lookout-{what}-{uuid.uuid4().hex}"


def _debounced_in_batches(spark, d):
    path = _scratch_table(spark, "debounce")
    for k, events in enumerate(batches := _deliveries(spark, d)):
        debounce_batch(events, path, k, _GAP, delay=_DELAY, last=k == len(batches) - 1)
    return path, batches[0].schema


@register(
    "debounce_stateful",
    f"""WITH {_DELIVERED_SQL}
SELECT session_id, ts, event_id, text FROM (
  SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS next_ts FROM marked WHERE NOT late
) s WHERE next_ts IS NULL OR next_ts > ts + INTERVAL '{_GAP}'""",
)
def debounce_stateful_q(spark, d):
    """All events in three deliveries, each a micro-batch over the state of those before."""
    return read_debounced(spark, *_debounced_in_batches(spark, d))


@register(
    "debounce_late_rows",
    f"WITH {_DELIVERED_SQL} SELECT session_id, ts, event_id, text, CAST(batch_id AS BIGINT) AS batch_id FROM marked WHERE late",
)
def debounce_late_rows_q(spark, d):
    """What came behind the watermark."""
    return read_late(spark, *_debounced_in_batches(spark, d))


@register(
    "latest_snapshot",
    """SELECT user_id AS session_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
              arg_max(event_type, (ts, event_id)) AS text
       FROM events WHERE length(event_type) >= 3 AND ts IS NOT NULL GROUP BY user_id""",
)
def latest_snapshot_q(spark, d):
    """One row a session, upserted delivery by delivery, the newest first."""
    path = _scratch_table(spark, "latest")
    for events in reversed(_deliveries(spark, d)):
        upsert(accepted(events).where("ts IS NOT NULL"), path, ["session_id"], ["ts", "event_id"], buckets=8)
    return read_keyed(spark, path)


@register("debounce_search_indexed", ORACLE["debounce_search"])
def debounce_search_indexed_q(spark, d):
    """The hits of ``debounce_search`` from an index that was built in two versions (C4)."""
    cfg = PLACE.replace(limit=3)
    path, rows = _scratch_table(spark, "places"), X.places(spark, d)
    postings.build(rows.where("place_id % 3 > 0"), cfg, path, rows_per_part=4096)
    index = postings.append(rows.where("place_id % 3 = 0"), cfg, path, rows_per_part=4096)
    return search_debounced(debounce(X.name_keystrokes(spark, d), _GAP), index, cfg)


# --------------------------------------------------------------------------- D geometry

_KIND = "place_id % 6"


@register(
    "geom_class",
    f"""SELECT place_id,
        CASE {_KIND} WHEN 0 THEN 'point' WHEN 1 THEN 'line' WHEN 2 THEN 'polygon' WHEN 3 THEN 'line'
             ELSE 'unknown' END AS geom_class,
        CASE {_KIND} WHEN 0 THEN 'marker' WHEN 1 THEN 'outline' WHEN 2 THEN 'outline' WHEN 3 THEN 'outline'
             END AS display_kind
        FROM {PLACES} p""",
)
def geom_class_q(spark, d):
    p = X.places(spark, d)
    cls = p.select("place_id", G.geom_class("geom").alias("geom_class"))
    return cls.select("place_id", "geom_class", G.display_kind("geom_class").alias("display_kind"))


@register(
    "envelope",
    f"""SELECT place_id,
        CAST(CASE WHEN {_KIND} < 4 THEN lon END AS DOUBLE) AS env_xmin,
        CAST(CASE WHEN {_KIND} < 4 THEN lat END AS DOUBLE) AS env_ymin,
        CAST(CASE {_KIND} WHEN 0 THEN lon WHEN 1 THEN lon + 3 WHEN 2 THEN lon + 4 WHEN 3 THEN lon + 5 END AS DOUBLE)
          AS env_xmax,
        CAST(CASE {_KIND} WHEN 0 THEN lat WHEN 1 THEN lat + 3 WHEN 2 THEN lat + 2 WHEN 3 THEN lat END AS DOUBLE)
          AS env_ymax,
        CAST(CASE {_KIND} WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 0 END AS INTEGER) AS n_coords
        FROM {PLACES} p""",
)
def envelope_q(spark, d):
    p = X.places(spark, d)
    coords = p.select("place_id", G.wkt_coords("geom").alias("coords"))
    env = coords.select("place_id", "coords", G.envelope("coords").alias("env"))
    return env.select(
        "place_id",
        *[F.col(f"env.{k}").alias(f"env_{k}") for k in ("xmin", "ymin", "xmax", "ymax")],
        F.size("coords").alias("n_coords"),
    )


@register(
    "centroid",
    f"""SELECT place_id,
        round(CAST(CASE {_KIND} WHEN 0 THEN lon WHEN 1 THEN lon + 1.75 WHEN 2 THEN lon + 2 WHEN 3 THEN lon + 2.5 END
              AS DOUBLE), 6) AS cx,
        round(CAST(CASE {_KIND} WHEN 0 THEN lat WHEN 1 THEN lat + 1.25 WHEN 2 THEN lat + 1 WHEN 3 THEN lat END
              AS DOUBLE), 6) AS cy
        FROM {PLACES} p""",
)
def centroid_q(spark, d):
    g = with_geometry(X.places(spark, d).select("place_id", "geom", "epsg"))
    return g.select("place_id", F.round("centroid.x", 6).alias("cx"), F.round("centroid.y", 6).alias("cy"))


_R = 6378137.0


def _merc_x(expr: str) -> str:
    return f"({expr}) * pi() / 180.0 * {_R}"


def _merc_y(expr: str) -> str:
    return f"ln(tan(pi() / 4.0 + ({expr}) * pi() / 360.0)) * {_R}"


def _merc_line_centroid(axis: str, pts: list[tuple[str, str]]) -> str:
    """Length-weighted segment midpoints of a projected polyline, as SQL."""
    proj = [(_merc_x(x), _merc_y(y)) for x, y in pts]
    segs = list(zip(proj, proj[1:]))
    lens = [f"sqrt(power(({b[0]}) - ({a[0]}), 2) + power(({b[1]}) - ({a[1]}), 2))" for a, b in segs]
    i = 0 if axis == "x" else 1
    num = " + ".join(f"({ln}) * (({a[i]}) + ({b[i]})) / 2.0" for ln, (a, b) in zip(lens, segs))
    return f"(({num}) / ({' + '.join(f'({ln})' for ln in lens)}))"


_LINE = [("lon", "lat"), ("lon + 2", "lat + 1"), ("lon + 3", "lat + 3")]


def _reproject_sql() -> str:
    cx = (
        f"CASE {_KIND} WHEN 0 THEN {_merc_x('lon')} WHEN 1 THEN {_merc_line_centroid('x', _LINE)} "
        f"WHEN 2 THEN {_merc_x('lon + 2')} WHEN 3 THEN {_merc_x('lon + 2.5')} END"
    )
    cy = (
        f"CASE {_KIND} WHEN 0 THEN {_merc_y('lat')} WHEN 1 THEN {_merc_line_centroid('y', _LINE)} "
        f"WHEN 2 THEN (({_merc_y('lat')}) + ({_merc_y('lat + 2')})) / 2.0 WHEN 3 THEN {_merc_y('lat')} END"
    )
    ex = f"CASE {_KIND} WHEN 0 THEN lon WHEN 1 THEN lon + 3 WHEN 2 THEN lon + 4 WHEN 3 THEN lon + 5 END"
    ey = f"CASE {_KIND} WHEN 0 THEN lat WHEN 1 THEN lat + 3 WHEN 2 THEN lat + 2 WHEN 3 THEN lat END"
    cols = {
        "mx": cx,
        "my": cy,
        "env_xmin": f"CASE WHEN {_KIND} < 4 THEN {_merc_x('lon')} END",
        "env_ymin": f"CASE WHEN {_KIND} < 4 THEN {_merc_y('lat')} END",
        "env_xmax": f"CASE WHEN {_KIND} < 4 THEN {_merc_x(ex)} END",
        "env_ymax": f"CASE WHEN {_KIND} < 4 THEN {_merc_y(ey)} END",
    }
    for k in ("xmin", "xmax"):
        cols[f"bbox_{k}"] = f"CASE WHEN {_BBOX_OK} THEN {_merc_x(_BBOX_SQL[k])} END"
    for k in ("ymin", "ymax"):
        cols[f"bbox_{k}"] = f"CASE WHEN {_BBOX_OK} THEN {_merc_y(_BBOX_SQL[k])} END"
    body = ", ".join(f"round({v}, 1) + 0.0 AS {k}" for k, v in cols.items())
    return f"SELECT place_id, {body} FROM {PLACES} p"


def reproject_3857_q(spark, d):
    p = X.places(spark, d)
    g = with_geometry(p.select("place_id", "geom", "epsg", "bbox_text"), dst_srid=3857)
    g = g.select("*", V.bbox_from_text("bbox_text").alias("bbox4326"))
    g = g.select("*", V.reproject_rect("bbox4326", "epsg", 3857).alias("bbox3857"))

    def r1(c):  # 0.1 m, with -0.0 folded into 0.0
        return F.round(c, 1) + F.lit(0.0)

    return g.select(
        "place_id",
        r1(F.col("centroid.x")).alias("mx"),
        r1(F.col("centroid.y")).alias("my"),
        *[r1(F.col(f"envelope.{k}")).alias(f"env_{k}") for k in ("xmin", "ymin", "xmax", "ymax")],
        *[r1(F.col(f"bbox3857.{k}")).alias(f"bbox_{k}") for k in ("xmin", "ymin", "xmax", "ymax")],
    )


_BBOX_PARTS = "string_split(bbox_text, ',')"
_BBOX_OK = (
    f"(bbox_text IS NOT NULL AND length(bbox_text) > 0 AND len({_BBOX_PARTS}) = 4 "
    f"AND list_bool_and(list_transform({_BBOX_PARTS}, lambda x: TRY_CAST(trim(x) AS DOUBLE) IS NOT NULL)))"
)


def _bbox_num(i: int) -> str:
    return f"TRY_CAST(trim({_BBOX_PARTS}[{i}]) AS DOUBLE)"


_BBOX_SQL = {
    "xmin": f"least({_bbox_num(1)}, {_bbox_num(3)})",
    "ymin": f"least({_bbox_num(2)}, {_bbox_num(4)})",
    "xmax": f"greatest({_bbox_num(1)}, {_bbox_num(3)})",
    "ymax": f"greatest({_bbox_num(2)}, {_bbox_num(4)})",
}


register("reproject_3857", _reproject_sql())(reproject_3857_q)


def _utm_sql() -> str:
    """Krüger's series spelled out step by step, there and back."""

    def series(factors, first, x, second, y):
        return " + ".join(f"{c!r} * {first}({2 * k} * {x}) * {second}({2 * k} * {y})" for k, c in enumerate(factors, 1))

    back = " + ".join(f"{c!r} * sin({2 * k} * chi)" for k, c in enumerate(T._DELTA, 1))
    return f"""
WITH a AS (
  SELECT place_id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone,
         CASE WHEN lat < 0 THEN 10000000.0 ELSE 0.0 END AS fn FROM {PLACES} p),
b AS (SELECT *, radians(lon - (zone * 6 - 183)) AS dl, sin(radians(lat)) AS s FROM a),
c AS (SELECT *, sinh(atanh(s) - {T._E!r} * atanh({T._E!r} * s)) AS t FROM b),
d AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM c),
e AS (
  SELECT *, 500000 + {T._RADIUS!r} * (eta + {series(T._ALPHA, "cos", "xi", "sinh", "eta")}) AS east,
         fn + {T._RADIUS!r} * (xi + {series(T._ALPHA, "sin", "xi", "cosh", "eta")}) AS north FROM d),
f AS (SELECT *, (north - fn) / {T._RADIUS!r} AS gx, (east - 500000) / {T._RADIUS!r} AS ge FROM e),
g AS (
  SELECT *, gx - ({series(T._BETA, "sin", "gx", "cosh", "ge")}) AS sx, ge - ({series(T._BETA, "cos", "gx", "sinh", "ge")}) AS se FROM f),
h AS (SELECT *, asin(sin(sx) / cosh(se)) AS chi FROM g)
SELECT place_id, zone + CASE WHEN lat < 0 THEN 32700 ELSE 32600 END AS utm, round(east, 3) + 0.0 AS east, round(north, 3) + 0.0 AS north,
       round(zone * 6 - 183 + degrees(atan2(sinh(se), cos(sx))), 7) + 0.0 AS lon_back, round(degrees(chi + {back}), 7) + 0.0 AS lat_back
FROM h"""


@register("reproject_utm", _utm_sql())
def reproject_utm_q(spark, d):
    p = X.places(spark, d).selectExpr(
        "place_id",
        "named_struct('x', CAST(lon AS DOUBLE), 'y', CAST(lat AS DOUBLE)) AS at",
        "CAST(floor((lon + 180) / 6) AS INT) + 1 + IF(lat < 0, 32700, 32600) AS utm",
    )
    p = p.select("*", G.reproject_point("at", 4326, "utm").alias("grid"))
    p = p.select("*", G.reproject_point("grid", "utm", 4326).alias("back"))

    def r(c, digits):
        return F.round(c, digits) + F.lit(0.0)

    return p.select(
        "place_id",
        "utm",
        r(F.col("grid.x"), 3).alias("east"),
        r(F.col("grid.y"), 3).alias("north"),
        r(F.col("back.x"), 7).alias("lon_back"),
        r(F.col("back.y"), 7).alias("lat_back"),
    )


@register(
    "bbox_parse",
    f"""SELECT place_id, bbox_text,
        {", ".join(f"CASE WHEN {_BBOX_OK} THEN {v} END AS bbox_{k}" for k, v in _BBOX_SQL.items())}
        FROM {PLACES} p""",
)
def bbox_parse_q(spark, d):
    p = X.places(spark, d)
    r = p.select("place_id", "bbox_text", V.bbox_from_text("bbox_text").alias("r"))
    return r.select("place_id", "bbox_text", *[F.col(f"r.{k}").alias(f"bbox_{k}") for k in ("xmin", "ymin", "xmax", "ymax")])


@register(
    "srid_from_authid",
    f"""SELECT place_id, authid,
        CASE WHEN regexp_matches(authid, '^EPSG:[0-9]+$') THEN CAST(substr(authid, 6) AS INTEGER) END AS srid
        FROM {PLACES} p""",
)
def srid_from_authid_q(spark, d):
    p = X.places(spark, d)
    return p.select("place_id", "authid", G.srid_from_authid("authid").alias("srid"))


# map state for the viewport queries: extent (-10,-10,10,10), scale 1:1 000 000, EPSG:4326
_MAP = (-10.0, -10.0, 10.0, 10.0)
_MAP_SCALE = 1_000_000.0
_SCALE_EXPR = "context2 * 1000"
_SCALE_SQL = "COALESCE(CAST(context2 * 1000 AS DOUBLE), 2000.0)"


def _viewport_sql() -> str:
    f = f"({_SCALE_SQL} / {_MAP_SCALE})"
    cx = f"CASE {_KIND} WHEN 0 THEN lon WHEN 3 THEN lon + 2.5 END"
    cy = "lat"
    env = {
        "xmin": "lon",
        "ymin": "lat",
        "xmax": f"CASE {_KIND} WHEN 1 THEN lon + 3 ELSE lon + 4 END",
        "ymax": f"CASE {_KIND} WHEN 1 THEN lat + 3 ELSE lat + 2 END",
    }
    grown = {
        "xmin": f"(({env['xmin']}) + ({env['xmax']})) / 2.0 - (({env['xmax']}) - ({env['xmin']})) * 1.2 / 2.0",
        "xmax": f"(({env['xmin']}) + ({env['xmax']})) / 2.0 + (({env['xmax']}) - ({env['xmin']})) * 1.2 / 2.0",
        "ymin": f"(({env['ymin']}) + ({env['ymax']})) / 2.0 - (({env['ymax']}) - ({env['ymin']})) * 1.2 / 2.0",
        "ymax": f"(({env['ymin']}) + ({env['ymax']})) / 2.0 + (({env['ymax']}) - ({env['ymin']})) * 1.2 / 2.0",
    }
    scaled = {
        "xmin": f"({cx}) - 20.0 * {f} / 2.0",
        "xmax": f"({cx}) + 20.0 * {f} / 2.0",
        "ymin": f"({cy}) - 20.0 * {f} / 2.0",
        "ymax": f"({cy}) + 20.0 * {f} / 2.0",
    }
    cols = []
    for k in ("xmin", "ymin", "xmax", "ymax"):
        cols.append(
            f"round(CASE WHEN {_KIND} >= 4 THEN NULL WHEN {_BBOX_OK} THEN {_BBOX_SQL[k]} "
            f"WHEN {_KIND} IN (0, 3) THEN {scaled[k]} ELSE {grown[k]} END, 6) AS view_{k}"
        )
    return f"SELECT place_id, {', '.join(cols)} FROM {PLACES} p"


@register("viewport", _viewport_sql())
def viewport_q(spark, d):
    cfg = PLACE.replace(scale_expr=_SCALE_EXPR, bbox_expr="bbox_text", limit=None)
    hits = search(X.places(spark, d), "   ", cfg, ordered=False)
    v = with_viewport(hits, _MAP, _MAP_SCALE, 4326)
    return v.select("place_id", *[F.round(f"viewport.{k}", 6).alias(f"view_{k}") for k in ("xmin", "ymin", "xmax", "ymax")])


# the same map in web Mercator: extent +-1 000 km, scale 1:1 000 000
_MAP_3857 = (-1_000_000.0, -1_000_000.0, 1_000_000.0, 1_000_000.0)


def _viewport_3857_sql() -> str:
    f = f"({_SCALE_SQL} / {_MAP_SCALE})"
    half = f"2000000.0 * {f} / 2.0"
    cx = f"CASE {_KIND} WHEN 0 THEN {_merc_x('lon')} WHEN 3 THEN {_merc_x('lon + 2.5')} END"
    cy = _merc_y("lat")
    ex_max = f"CASE {_KIND} WHEN 1 THEN lon + 3 ELSE lon + 4 END"
    ey_max = f"CASE {_KIND} WHEN 1 THEN lat + 3 ELSE lat + 2 END"
    env = {"xmin": _merc_x("lon"), "ymin": _merc_y("lat"), "xmax": _merc_x(ex_max), "ymax": _merc_y(ey_max)}

    def grown(lo: str, hi: str, k: str) -> str:
        c = f"(({env[lo]}) + ({env[hi]})) / 2.0"
        h = f"(({env[hi]}) - ({env[lo]})) * 1.2 / 2.0"
        return f"{c} - {h}" if k.endswith("min") else f"{c} + {h}"

    bbox = {
        "xmin": _merc_x(_BBOX_SQL["xmin"]),
        "ymin": _merc_y(_BBOX_SQL["ymin"]),
        "xmax": _merc_x(_BBOX_SQL["xmax"]),
        "ymax": _merc_y(_BBOX_SQL["ymax"]),
    }
    scaled = {
        "xmin": f"({cx}) - {half}",
        "xmax": f"({cx}) + {half}",
        "ymin": f"({cy}) - {half}",
        "ymax": f"({cy}) + {half}",
    }
    cols = []
    for k in ("xmin", "ymin", "xmax", "ymax"):
        lo, hi = ("xmin", "xmax") if k[0] == "x" else ("ymin", "ymax")
        cols.append(
            f"round(CASE WHEN {_KIND} >= 4 THEN NULL WHEN {_BBOX_OK} THEN {bbox[k]} "
            f"WHEN {_KIND} IN (0, 3) THEN {scaled[k]} ELSE {grown(lo, hi, k)} END, 1) + 0.0 AS view_{k}"
        )
    return f"SELECT place_id, {', '.join(cols)} FROM {PLACES} p"


@register("viewport_3857", _viewport_3857_sql())
def viewport_3857_q(spark, d):
    cfg = PLACE.replace(scale_expr=_SCALE_EXPR, bbox_expr="bbox_text", limit=None)
    hits = search(X.places(spark, d), "   ", cfg, ordered=False)
    v = with_viewport(hits, _MAP_3857, _MAP_SCALE, 3857)
    return v.select(
        "place_id", *[(F.round(f"viewport.{k}", 1) + F.lit(0.0)).alias(f"view_{k}") for k in ("xmin", "ymin", "xmax", "ymax")]
    )


@register(
    "expr_default",
    f"""SELECT place_id,
        COALESCE(CAST(1000.0 / NULLIF(place_id % 3, 0) AS DOUBLE), 2000.0) AS by_division,
        COALESCE(TRY_CAST(context1 AS DOUBLE), 2000.0) AS by_cast,
        CAST(2000.0 AS DOUBLE) AS by_bad_column,
        CAST(1 + 2 AS INTEGER) AS doc_example
        FROM {PLACES} p""",
)
def expr_default_q(spark, d):
    p = X.places(spark, d).select("place_id", "context1").withColumn("a", F.lit(2))
    p = with_expression(p, "by_division", "1000.0 / (place_id % 3)", 2000.0, "double")
    p = with_expression(p, "by_cast", "cast(context1 as double)", 2000.0, "double")
    p = with_expression(p, "by_bad_column", "no_such_column * 2", 2000.0, "double")
    p = with_expression(p, "doc_example", "1 + a", None, "int")
    return p.select("place_id", "by_division", "by_cast", "by_bad_column", "doc_example")


@register(
    "search_patterns",
    """SELECT query_id,
        CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) = 0 THEN '%'
             ELSE '%' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), '%') || '%' END
          AS pattern
        FROM (SELECT CAST(c_custkey AS BIGINT) AS query_id, replace(replace(c_name, '#', '  '), '0', ' ') AS text
              FROM customer) c""",
)
def search_patterns(spark, d):
    q = X.load(spark, d, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS query_id", "replace(replace(c_name, '#', '  '), '0', ' ') AS text"
    )
    return q.select("query_id", wildcard_pattern(F.col("text")).alias("pattern"))
