"""Bbox text, rectangle reprojection, viewport rule, user expressions."""

import math

import pytest
from pyspark.sql import functions as F

from lookout import with_expression, with_viewport
from lookout.functions import viewport as V


def test_bbox_from_text(spark):
    texts = ["1,2,3,4", " 1 , 2 , 3 , 4 ", "3,4,1,2", "1,2,3", "1,2,x,4", "", None, "1,2,3,4,5", "1e1,2,3,4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r.b is None else tuple(r.b) for r in df.select(V.bbox_from_text("t").alias("b")).collect()]
    assert got == [(1, 2, 3, 4), (1, 2, 3, 4), (1, 2, 3, 4), None, None, None, None, None, (3, 2, 10, 4)]


def test_reproject_rect(spark):
    df = spark.createDataFrame([(1,)], "x int").select(V.rect(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("b"))
    got = df.select(V.reproject_rect("b", 4326, 3857).alias("r")).first().r
    assert got.xmax == pytest.approx(math.radians(10) * 6378137.0)
    assert got.xmin == pytest.approx(0.0)


def hits(spark, rows):
    return spark.createDataFrame(rows, "id int, geom string, epsg int, bbox_text string, scale_denom double")


def test_viewport_rules(spark):
    rows = [
        (1, "POINT (1 1)", 4326, "0,0,2,3", None),  # bbox wins
        (2, "POINT (1 1)", 4326, None, 4000.0),  # degenerate: map extent x 4000/1e6 about the point
        (3, "LINESTRING (0 5, 10 5)", 4326, "bad", None),  # horizontal line is degenerate; default scale 2000
        (4, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 4326, "", 1.0),  # grown 1.2 about centre
        (5, None, 4326, "0,0,1,1", None),  # no geometry: no map work, even with a bbox
        (6, "POINT (1 1)", 27700, None, None),  # unsupported reprojection
    ]
    out = {r.id: r for r in with_viewport(hits(spark, rows), (-10, -10, 10, 10), 1_000_000, 4326).collect()}
    assert tuple(out[1].viewport) == pytest.approx((0, 0, 2, 3))
    assert tuple(out[2].viewport) == pytest.approx((1 - 0.04, 1 - 0.04, 1 + 0.04, 1 + 0.04))
    assert tuple(out[3].viewport) == pytest.approx((5 - 0.02, 5 - 0.02, 5 + 0.02, 5 + 0.02))
    assert tuple(out[4].viewport) == pytest.approx((-1, -1, 11, 11))
    assert out[5].viewport is None
    assert out[6].viewport is None


def test_expression_defaults(spark):
    df = spark.createDataFrame([(2, "3.5", 0), (None, "x", 1)], "a int, s string, z int")
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    out = with_expression(df, "doc", "1 + a", None, "int")
    out = with_expression(out, "div", "10 / z", 7.0, "double")
    out = with_expression(out, "cast", "cast(s as double)", 2000.0, "double")
    with pytest.warns(UserWarning):
        out = with_expression(out, "bad", "nope + 1", 2000.0, "double")
    out = with_expression(out, "empty", "", 2000.0, "double")
    rows = out.orderBy(F.col("z")).collect()
    assert [r.doc for r in rows] == [3, None]
    assert [r.div for r in rows] == [7.0, 10.0]
    assert [r.cast for r in rows] == [3.5, 2000.0]
    assert [r.bad for r in rows] == [2000.0, 2000.0]
    assert [r.empty for r in rows] == [2000.0, 2000.0]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_bbox_rejects_suffixed_numbers(spark):
    df = spark.createDataFrame([("1d,2f,3,4",), ("1e2, -2 ,3.5,+4",), ("NaN,1,2,3",)], "t string")
    got = [None if r.b is None else tuple(r.b) for r in df.select(V.bbox_from_text("t").alias("b")).collect()]
    assert got == [None, (3.5, -2.0, 100.0, 4.0), None]
