"""Every registered query against its DuckDB oracle (the driver's check), at sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows_of  # noqa: E402

from lookout.plans.fixtures import TABLES  # noqa: E402

from conftest import SF_SMALL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"geom", "epsg", "suggestion", "viewport"} <= set(df.columns)


def test_every_query_has_unique_columns(spark):
    for name, fn in E.queries().items():
        cols = fn(spark, SF_SMALL).columns
        assert len(cols) == len(set(cols)), name


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(o_cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(o_cols, cur.fetchall())


def test_rows_only_queries_run(spark):
    for name in set(E.queries()) - set(E.oracle_sql()):
        assert E.queries()[name](spark, SF_SMALL).count() >= 0
