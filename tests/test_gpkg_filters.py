"""A3: filters and searches that reach the GeoPackage file; every one gives Spark's own rows."""

import json
import os
import random
import sqlite3

import pytest
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lookout import SearchConfig, search
from lookout.sources.gpkg import GeoPackageReader, read_layer
from lookout.sources.tables import read_source

SCHEMA = StructType(
    [StructField("fid", LongType()), StructField("geom", StringType()), StructField("srs_id", IntegerType()), StructField("authid", StringType())]
    + [StructField("name", StringType()), StructField("n", LongType()), StructField("x", DoubleType())]
)
NAMES = ["Ring Road", "ring", "RİNG", "Kelvin", "kelvin", "a%b_c\\d", "", None, b"blob", "a\0ring", "Étoile ring", 12, 3.5]
NUMBERS = [None, 0, 7, -3, (1 << 53) + 1, -(1 << 63), "seven", "12", 2.0, 2.5]
REALS = [None, 0.0, -0.0, 1.5, float("inf"), 1 << 53, "nan", "x", 7]


def make(path, ids):
    rnd = random.Random(1)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, geometry_type_name, srs_id, z, m)")
        con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_id, organization, organization_coordsys_id)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 'POINT', 4326, 0, 0)")
        con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'epsg', 4326)")
        con.execute("CREATE TABLE t (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT COLLATE NOCASE, n INTEGER, x REAL)")
        rows = [(i, None, rnd.choice(NAMES), rnd.choice(NUMBERS), rnd.choice(REALS)) for i in ids]
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)


def reader(path, *filters, **options):
    asked = json.dumps([(*f, None)[:3] for f in filters])
    return GeoPackageReader({"path": path, "layer": "t", "filters": asked, **options}, SCHEMA)


def read(r):
    return [row for p in r.partitions() for row in r.read(p)]


NAN, INF = float("nan"), float("inf")
# filters, and the same in SQL
FILTERS = [
    ([("fid", "=", 17)], "fid = 17"),
    ([("fid", ">", 30), ("fid", "<=", 41)], "fid > 30 AND fid <= 41"),
    ([("fid", "in", [3, 5, 900, 100_000])], "fid IN (3, 5, 900, 100000)"),
    ([("fid", "<", 0)], "fid < 0"),
    ([("fid", ">=", 198)], "fid >= 198"),
    ([("fid", "in", [])], "false"),
    ([("name", "=", "ring")], "name = 'ring'"),
    ([("name", "in", ["ring", "kelvin", "zzz"])], "name IN ('ring', 'kelvin', 'zzz')"),
    ([("name", "is null")], "name IS NULL"),
    ([("name", "is not null")], "name IS NOT NULL"),
    ([("name", "=", "12")], "name = '12'"),
    ([("name", ">", "m")], "name > 'm'"),
    ([("name", "contains", "ring")], "contains(name, 'ring')"),
    ([("name", "startswith", "ring")], "startswith(name, 'ring')"),
    ([("name", "contains", "")], "contains(name, '')"),
    ([("n", "=", 7)], "n = 7"),
    ([("n", "=", 2)], "n = 2"),
    ([("n", "=", 12)], "n = 12"),
    ([("n", ">", 0)], "n > 0"),
    ([("n", "<=", -3)], "n <= -3"),
    ([("n", "is null")], "n IS NULL"),
    ([("n", "is not null")], "n IS NOT NULL"),
    ([("n", "in", [0, 7, 12])], "n IN (0, 7, 12)"),
    ([("n", "=", (1 << 53) + 1)], "n = 9007199254740993"),
    ([("x", "=", 0.0)], "x = 0"),
    ([("x", ">", 1.5)], "x > 1.5"),
    ([("x", "=", float(1 << 53))], "x = 9007199254740992"),
    ([("x", "<", NAN)], "x < double('NaN')"),
    ([("x", "=", NAN)], "x = double('NaN')"),
    ([("x", "is null")], "x IS NULL"),
    ([("x", "=", INF)], "x = double('Infinity')"),
    ([("fid", ">", 10), ("name", "=", "ring"), ("n", "is not null")], "fid > 10 AND name = 'ring' AND n IS NOT NULL"),
    ([("geom", "is not null")], "geom IS NOT NULL"),
    ([("authid", "=", "EPSG:4326"), ("srs_id", "=", 4326)], "authid = 'EPSG:4326' AND srs_id = 4326"),
]


def test_rows_are_those_of_spark(spark, scratch):
    path = os.path.join(scratch, "t.gpkg")
    make(path, [*range(1, 200), 100_000])
    rows = read_layer(spark, path, "t", schema=SCHEMA, rowsPerPartition=30).collect()
    assert len(rows) == 200
    plain = spark.createDataFrame(rows, SCHEMA)
    for filters, text in FILTERS:
        want = sorted(map(str, plain.where(text).collect()))
        got = read_layer(spark, path, "t", filters, schema=SCHEMA, rowsPerPartition=30)
        assert sorted(map(str, got.collect())) == want, text


@pytest.mark.parametrize("bad", [("fid", "=", None), ("fid", ">", "1"), ("name", "like", "x"), ("n", "in", [1, None]), ("name", "contains", 3)])
def test_what_is_no_filter(spark, scratch, bad):
    with pytest.raises(ValueError, match="not a filter"):
        read_layer(spark, scratch, "t", [bad])


def test_rows_read_fall(scratch):
    path = os.path.join(scratch, "t.gpkg")
    make(path, range(1, 1001))
    assert len(read(reader(path))) == 1000
    assert [r[0] for r in read(reader(path, ("fid", "=", 500)))] == [500]
    narrow = reader(path, ("fid", ">", 100), ("fid", "<=", 150), rowsPerPartition="20")
    assert len(read(narrow)) == 50 and len(narrow.partitions()) == 3
    assert len(read(reader(path, ("fid", "in", [2, 900])))) == 2
    assert read(reader(path, ("fid", ">", 5000))) == []
    few = read(reader(path, ("name", "=", "ring")))
    # blobs, numbers and nulls are for Spark to judge
    assert len(few) < 450 and sum(r[4] == "ring" for r in few) == sum(r[4] == "ring" for r in read(reader(path)))
    assert len(read(reader(path, ("n", "is not null"), ("x", "is not null")))) < 900


@pytest.mark.parametrize("ids", [range(1, 101), [*range(1, 50), 10**12, *range(10**15, 10**15 + 51)], [-(1 << 63), -5, 0, (1 << 63) - 1], [7]])
def test_ranges_hold_every_row_once_and_no_more_than_asked(scratch, ids):
    path = os.path.join(scratch, "t.gpkg")
    make(path, ids)
    for rows in (1, 7, 1000):
        r = reader(path, rowsPerPartition=str(rows))
        per = [[row[0] for row in r.read(p)] for p in r.partitions()]
        assert sorted(i for p in per for i in p) == sorted(ids)
        assert max(map(len, per)) <= rows


@pytest.mark.parametrize("text", ["ring", "RING road", "kelvin", "a%b", "_c\\d", "étoile", "12", "", "zzz", "i g"])
@pytest.mark.parametrize("rules", [{}, {"case_sensitive": True}, {"escape_spec_chars": True}, {"accent_sensitive": False}])
def test_search_reaches_the_file(spark, scratch, text, rules):
    path = os.path.join(scratch, "t.gpkg")
    make(path, range(1, 200))
    cfg = SearchConfig(search_column="name", tie_break="fid", extra_columns=("fid",), data_type="gpkg", path=path, layer="t", **rules)
    whole, less = read_source(spark, cfg), read_source(spark, cfg, text)
    assert less.columns == whole.columns
    assert [tuple(r) for r in search(less, text, cfg).collect()] == [tuple(r) for r in search(whole, text, cfg).collect()]
    if text == "zzz":
        assert less.count() < 0.7 * whole.count()
