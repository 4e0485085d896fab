"""Table scan, JDBC options, GeoPackage reader, hit writer."""

import os
import sqlite3
import struct

import pytest

from lookout import SearchConfig, search
from lookout.sources.gpkg import gpkg_blob_to_wkt, list_layers, register
from lookout.sources.jdbc import jdbc_options
from lookout.sources.tables import read_source, write_hits

from conftest import SF_SMALL


def test_postgres_options_omit_empty_fields():
    cfg = SearchConfig(
        search_column="n", tie_break="id", data_type="postgres", schema="pub", table='t"x',
        connection={"host": "db", "port": "5433", "database": "gis", "user": "u", "password": ""},
    )
    o = jdbc_options(cfg)
    assert o["url"] == "jdbc:postgresql://db:5433/gis"
    assert o["dbtable"] == '"pub"."t""x"'
    assert o["user"] == "u" and "password" not in o
    svc = SearchConfig(
        search_column="n", tie_break="id", data_type="postgres", table="t", connection={"service": "gazetteer"}
    )
    assert jdbc_options(svc)["url"] == "jdbc:postgresql:/?service=gazetteer"


def test_mssql_and_oracle_urls():
    ms = SearchConfig(search_column="n", tie_break="id", data_type="mssql", schema="dbo", table="t",
                      connection={"host": "h", "database": "d"})
    assert jdbc_options(ms)["url"] == "jdbc:sqlserver://h;databaseName=d;integratedSecurity=true"
    assert jdbc_options(ms)["dbtable"] == "[dbo].[t]"
    dsn = ms.replace(connection={"service": "jdbc:sqlserver://x;databaseName=y", "password": "p", "user": "u"})
    assert jdbc_options(dsn)["url"] == "jdbc:sqlserver://x;databaseName=y"
    ora = SearchConfig(search_column="n", tie_break="id", data_type="oracle", table="T",
                       connection={"host": "h", "port": 1521, "database": "orcl", "num_partitions": 8,
                                   "partition_column": "ID", "lower_bound": 0, "upper_bound": 1000})
    o = jdbc_options(ora)
    assert o["url"] == "jdbc:oracle:thin:@//h/orcl"
    assert o["numPartitions"] == "8" and o["partitionColumn"] == "ID"
    assert jdbc_options(ora.replace(connection={"host": "h", "port": 1600}))["url"] == "jdbc:oracle:thin:@//h:1600"


def test_read_parquet_and_write(spark, scratch):
    cfg = SearchConfig(search_column="p_name", tie_break="p_partkey", data_type="parquet",
                       path=f"{SF_SMALL}/part.parquet", extra_columns=("p_partkey",))
    hits = search(read_source(spark, cfg), "red w", cfg)
    out = os.path.join(scratch, "hits")
    write_hits(hits, path=out)
    assert spark.read.parquet(out).count() == hits.count() > 0
    with pytest.raises(ValueError):
        read_source(spark, cfg.replace(data_type="dataframe"))


# --------------------------------------------------------------------------- GeoPackage fixture


def gp_blob(wkb: bytes, srs_id: int = 4326) -> bytes:
    return b"GP" + bytes([0, 0b00000001]) + struct.pack("<i", srs_id) + wkb


def wkb_point(x, y):
    return struct.pack("<BIdd", 1, 1, x, y)


def wkb_line(pts):
    return struct.pack("<BII", 1, 2, len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)


def wkb_polygon(rings):
    out = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return out


def wkb_multipoint_z(pts):
    return struct.pack("<BII", 1, 1004, len(pts)) + b"".join(struct.pack("<BIddd", 1, 1001, *p) for p in pts)


def make_gpkg(path, n=7):
    con = sqlite3.connect(path)
    con.executescript(
        """
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT,
            organization_coordsys_id INTEGER, definition TEXT, description TEXT);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT,
            srs_id INTEGER, z INTEGER, m INTEGER);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, '', '');
        INSERT INTO gpkg_contents VALUES ('places', 'features', 'places'), ('notes', 'attributes', 'notes');
        INSERT INTO gpkg_geometry_columns VALUES ('places', 'geom', 'GEOMETRY', 4326, 0, 0);
        CREATE TABLE places (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, context1 TEXT, context2 INTEGER);
        CREATE TABLE notes (id INTEGER PRIMARY KEY, txt TEXT);
        INSERT INTO notes VALUES (1, 'no geometry here');
        """
    )
    geoms = [
        gp_blob(wkb_point(1, 2)),
        gp_blob(wkb_line([(0, 0), (2, 0), (2, 2)])),
        gp_blob(wkb_polygon([[(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]])),
        gp_blob(wkb_multipoint_z([(1, 1, 5), (3, 3, 6)])),
        None,
        gp_blob(wkb_point(1.5, -2.25)),
        gp_blob(wkb_point(0, 0)),
    ]
    rows = [(i + 1, geoms[i % len(geoms)], f"Place {i + 1}", ["", "town", None][i % 3], i % 4) for i in range(n)]
    con.executemany("INSERT INTO places VALUES (?, ?, ?, ?, ?)", rows)
    con.commit()
    con.close()


def test_blob_parsing():
    assert gpkg_blob_to_wkt(gp_blob(wkb_point(1, 2))) == "POINT (1 2)"
    assert gpkg_blob_to_wkt(gp_blob(wkb_multipoint_z([(1, 1, 5)]))) == "MULTIPOINT Z ((1 1 5))"
    assert gpkg_blob_to_wkt(gp_blob(wkb_polygon([[(0, 0), (1, 0), (0, 1), (0, 0)]]))) == "POLYGON ((0 0, 1 0, 0 1, 0 0))"
    assert gpkg_blob_to_wkt(None) is None


def test_gpkg_reader(spark, scratch):
    register(spark)
    path = os.path.join(scratch, "places.gpkg")
    make_gpkg(path, n=9)
    assert list_layers(path) == ["places"]
    df = spark.read.format("gpkg").option("layer", "places").option("rowsPerPartition", 2).load(path)
    assert df.columns == ["fid", "geom", "srs_id", "authid", "name", "context1", "context2"]
    assert df.rdd.getNumPartitions() == 5
    rows = {r.fid: r for r in df.collect()}
    assert len(rows) == 9
    assert rows[1].geom == "POINT (1 2)" and rows[1].authid == "EPSG:4326"
    assert rows[5].geom is None
    assert rows[6].geom == "POINT (1.5 -2.25)"
    # the reference's GeoPackage search: skip-falsy suggestion, unordered, authid -> SRID
    cfg = SearchConfig.for_profile(
        "gpkg", search_column="name", tie_break="fid", display_columns=("context1", "context2"),
        geom_column="geom", authid_column="authid", limit=0,
    )
    hits = {r.suggestion: r.epsg for r in search(df, "place 1", cfg).collect()}
    assert hits == {"Place 1": 4326}


def test_gpkg_refuses_attribute_layer(spark, scratch):
    register(spark)
    path = os.path.join(scratch, "p.gpkg")
    make_gpkg(path)
    with pytest.raises(Exception, match="no geometry"):
        spark.read.format("gpkg").option("layer", "notes").load(path).collect()


def test_gpkg_directory_of_files(spark, scratch):
    register(spark)
    for i in range(3):
        make_gpkg(os.path.join(scratch, f"f{i}.gpkg"), n=4)
    df = spark.read.format("gpkg").option("layer", "places").load(scratch)
    assert df.count() == 12


def test_blob_big_endian_with_envelope_and_empty_point():
    # flags: little-endian header (bit 0), envelope indicator 1 -> 4 doubles (32 bytes)
    header = b"GP" + bytes([0, 0b00000011]) + struct.pack("<i", 4326) + struct.pack("<dddd", 0, 2, 0, 3)
    wkb = struct.pack(">BI", 0, 2) + struct.pack(">I", 2) + struct.pack(">dd", 0, 0) + struct.pack(">dd", 2, 3)
    assert gpkg_blob_to_wkt(header + wkb) == "LINESTRING (0 0, 2 3)"
    nan = float("nan")
    assert gpkg_blob_to_wkt(gp_blob(struct.pack("<BIdd", 1, 1, nan, nan))) == "POINT EMPTY"


def test_settings_row_to_gpkg_search(spark, scratch):
    path = os.path.join(scratch, "places.gpkg")
    make_gpkg(path, n=12)
    cfg = SearchConfig.from_mapping(
        {
            "data_type": "gpkg",
            "file": path,
            "table": "places",
            "search_column": "name",
            "tie_break": "fid",
            "display_columns": "context1,context2",
            "geom_column": "geom",
            "authid_column": "authid",
            "echo_search_column": True,
            "limit_results": 0,
        }
    )
    hits = search(read_source(spark, cfg), "place 1", cfg)
    got = sorted((r.suggestion, r.epsg) for r in hits.collect())
    # row i: name "Place {i+1}", context1 cycles "", "town", None, context2 = i % 4;
    # the GeoPackage line drops empty text and zero
    assert got == [("Place 1", 4326), ("Place 10, 1", 4326), ("Place 11, town, 2", 4326), ("Place 12, 3", 4326)]


def test_geometry_projection_quotes_every_name():
    from lookout.sources.jdbc import jdbc_options

    base = dict(search_column='na"me', tie_break="id", geom_column="ge]om", srid="epsg", schema="s", table="t]", extra_columns="id")
    pg = jdbc_options(SearchConfig(data_type="postgres", connection={"database": "d"}, **base))["dbtable"]
    assert pg == '(SELECT s."na""me", s."id", ST_AsText(s."ge]om") AS "ge]om", ST_SRID(s."ge]om") AS "epsg" FROM "s"."t]" s) "lookout"'
    ms = jdbc_options(SearchConfig(data_type="mssql", connection={"host": "h"}, **base))["dbtable"]
    assert ms == "(SELECT s.[na\"me], s.[id], s.[ge]]om].STAsText() AS [ge]]om], s.[ge]]om].STSrid AS [epsg] FROM [s].[t]]] s) [lookout]"
    ora = jdbc_options(SearchConfig(data_type="oracle", connection={"host": "h"}, **base))["dbtable"]
    assert 'SDO_UTIL.TO_WKTGEOMETRY(s."ge]om") AS "ge]om", s."ge]om".SDO_SRID AS "epsg"' in ora


def test_gpkg_values_that_do_not_fit_and_sparse_ids(spark, scratch):
    import sqlite3

    from lookout.sources.gpkg import GeoPackageReader, register
    from pyspark.sql.types import StructType

    path = os.path.join(scratch, "odd.gpkg")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, geometry_type_name, srs_id, z, m)")
        con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_id, organization, organization_coordsys_id)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES ('odd', 'geom', 'POINT', 4326, 0, 0)")
        con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'epsg', 4326)")
        con.execute("CREATE TABLE odd (fid INTEGER PRIMARY KEY, geom BLOB, ok BOOLEAN, n INTEGER, x REAL, name TEXT)")
        con.execute("INSERT INTO odd VALUES (1, NULL, 1, 5, 1.5, 'a'), (20000000000, NULL, 'maybe', 'five', 'x', 7)")
    register(spark)
    df = spark.read.format("gpkg").option("layer", "odd").option("rowsPerPartition", 1).load(path)
    assert {tuple(r)[4:] for r in df.collect()} == {(True, 5, 1.5, "a"), (None, None, None, "7")}
    reader = GeoPackageReader({"path": path, "layer": "odd", "rowsPerPartition": "1"}, df.schema)
    assert len(reader.partitions()) == 2
    narrow = spark.read.format("gpkg").option("layer", "odd").schema(StructType(df.schema.fields[:4] + df.schema.fields[7:])).load(path)
    assert {r.name for r in narrow.collect()} == {"a", "7"}
