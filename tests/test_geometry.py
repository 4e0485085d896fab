"""WKT coordinates, class, envelope, centroid, SRID, reprojection."""

import math

import pytest
from pyspark.sql import functions as F

from lookout import with_geometry
from lookout.functions import geometry as G

CASES = [
    # wkt, class, envelope, centroid
    ("POINT (1 2)", "point", (1, 2, 1, 2), (1, 2)),
    ("POINT Z (1 2 3)", "point", (1, 2, 1, 2), (1, 2)),
    ("SRID=4326;POINT(1.5 -2e1)", "point", (1.5, -20, 1.5, -20), (1.5, -20)),
    ("MULTIPOINT ((0 0), (2 0), (4 6))", "point", (0, 0, 4, 6), (2, 2)),
    ("MULTIPOINT (0 0, 2 2)", "point", (0, 0, 2, 2), (1, 1)),
    ("LINESTRING (0 0, 2 0, 2 2)", "line", (0, 0, 2, 2), (1.5, 0.5)),
    ("LINESTRINGZM (0 0 5 6, 4 0 7 8)", "line", (0, 0, 4, 0), (2, 0)),
    ("MULTILINESTRING ((0 0, 2 0), (10 10, 10 14))", "line", (0, 0, 10, 14), (7, 8)),
    ("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", "polygon", (0, 0, 4, 2), (2, 1)),
    ("POLYGON ((0 0, 0 2, 4 2, 4 0, 0 0))", "polygon", (0, 0, 4, 2), (2, 1)),  # clockwise
    # 4x4 square with a 2x2 hole in its lower-left quadrant: area 12
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 0 2, 2 2, 2 0, 0 0))", "polygon", (0, 0, 4, 4), (14 / 6, 14 / 6)),
    ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 14 0, 14 2, 10 2, 10 0)))", "polygon", (0, 0, 14, 2), (25 / 3, 1)),
    ("POLYGON ((0 0, 2 0, 4 0, 0 0))", "polygon", (0, 0, 4, 0), (2, 0)),  # zero area -> line rule
    ("LINESTRING (3 3, 3 3)", "line", (3, 3, 3, 3), (3, 3)),  # zero length -> point rule
    ("GEOMETRYCOLLECTION EMPTY", "unknown", None, None),
    ("POINT EMPTY", "unknown", None, None),
    ("not a geometry", "unknown", None, None),
    (None, "unknown", None, None),
]


@pytest.fixture(scope="module")
def geo(spark):
    df = spark.createDataFrame([(i, c[0], 4326) for i, c in enumerate(CASES)], "i int, geom string, epsg int")
    return {r.i: r for r in with_geometry(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_geometry_case(geo, i):
    wkt, cls, env, cen = CASES[i]
    r = geo[i]
    assert r.geom_class == cls
    assert r.display_kind == {"point": "marker", "line": "outline", "polygon": "outline"}.get(cls)
    if env is None:
        assert r.envelope is None and r.centroid is None
    else:
        assert tuple(r.envelope) == pytest.approx(env)
        assert (r.centroid.x, r.centroid.y) == pytest.approx(cen)


def test_srid_from_authid(spark):
    df = spark.createDataFrame([("EPSG:27700",), ("USER:100001",), ("ESRI:54030",), (None,)], "a string")
    assert [r.s for r in df.select(G.srid_from_authid("a").alias("s")).collect()] == [27700, None, None, None]


def test_reprojection_round_trip(spark):
    df = spark.createDataFrame([(10.0, 50.0), (-179.0, -80.0), (0.0, 0.0)], "x double, y double")
    p = df.select(G.point(F.col("x"), F.col("y")).alias("p"))
    merc = p.select("p", G.reproject_point("p", 4326, 3857).alias("m"), G.reproject_point("p", 4326, 27700).alias("u"))
    rows = merc.select("m", "u", G.reproject_point("m", 3857, 4326).alias("b")).collect()
    for (x, y), r in zip([(10.0, 50.0), (-179.0, -80.0), (0.0, 0.0)], rows):
        assert r.m.x == pytest.approx(math.radians(x) * 6378137.0)
        assert r.m.y == pytest.approx(math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * 6378137.0, abs=1e-6)
        assert (r.b.x, r.b.y) == pytest.approx((x, y))
        assert r.u is None


def test_centroid_after_reprojection(spark):
    df = spark.createDataFrame([("POINT (10 50)", 4326), ("POINT (10 50)", 27700)], "geom string, epsg int")
    rows = with_geometry(df, dst_srid=3857).collect()
    assert rows[0].reprojection_supported and rows[0].centroid.x == pytest.approx(math.radians(10) * 6378137.0)
    assert not rows[1].reprojection_supported and rows[1].centroid is None


def test_spaced_parentheses_mark_the_exterior_ring(spark):
    from lookout import with_geometry

    tight = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"
    spaced = "POLYGON ( (0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1) )"
    df = spark.createDataFrame([(tight, 4326), (spaced, 4326)], "geom string, epsg int")
    a, b = (r.centroid for r in with_geometry(df).select("centroid").collect())
    assert a == b and a.x > 5
