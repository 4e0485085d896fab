import math

import pytest
from pyspark.sql import functions as F

from lookout.functions import geometry as G
from lookout.functions import viewport as V


def _points(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double, src int, dst int")
    df = df.select("*", F.struct("x", "y").alias("p"))
    return df.select("*", G.reproject_point("p", "src", "dst").alias("q"), G.supported_transform("src", "dst").alias("ok"))


def meridian_arc(latitude):
    """Length from the equator, by numerical integration of the radius of curvature."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    n, top = 20_000, math.radians(latitude)
    h = top / n
    total = 0.0
    for k in range(n):
        s = math.sin((k + 0.5) * h)
        total += (1 - e2 * s * s) ** -1.5
    return a * (1 - e2) * h * total


def test_known_values(spark):
    rows = [
        (9.0, 48.0, 4326, 32632),  # on the central meridian: the scaled arc
        (9.0, -48.0, 4326, 32732),
        (15.0, 0.0, 4326, 32633),
        (None, 1.0, 4326, 32632),
        (9.0, 48.0, 4326, 27700),
        (9.0, 48.0, 4326, 32661),
        (170.0, 10.0, 4326, 32632),  # too far from the zone
        (9.0, 90.0, 4326, 32632),
    ]
    got = _points(spark, rows).collect()
    assert got[0].q.x == pytest.approx(500000, abs=1e-6)
    assert got[0].q.y == pytest.approx(0.9996 * meridian_arc(48.0), abs=1e-3)
    assert got[1].q.y == pytest.approx(10_000_000 - 0.9996 * meridian_arc(48.0), abs=1e-3)
    assert (got[2].q.x, got[2].q.y) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    assert got[3].q is None or got[3].q.x is None
    assert [r.ok for r in got[4:6]] == [False, False] and got[4].q is None and got[5].q is None
    assert got[6].q is None and got[7].q is None


def test_round_trips(spark):
    rows = [(9 + dx, float(y), 4326, z) for dx in (-20.0, -3.0, 0.0, 2.9, 30.0) for y in (-80, -10, 0, 33, 84) for z in (32632, 32732)]
    there = _points(spark, rows).select(F.col("q.x").alias("x"), F.col("q.y").alias("y"), F.col("dst").alias("src"), F.lit(4326).alias("dst"), "p")
    back = there.select("p", F.struct("x", "y").alias("g"), "src", "dst").select("p", G.reproject_point("g", "src", "dst").alias("q"))
    for r in back.collect():
        assert r.q.x == pytest.approx(r.p.x, abs=1e-8) and r.q.y == pytest.approx(r.p.y, abs=1e-8)
    # through web Mercator, and from zone to zone, equals the way by degrees
    two = _points(spark, [(1e6, 6e6, 3857, 32632), (600000.0, 5300000.0, 32632, 32633), (600000.0, 5300000.0, 32632, 3857)])
    one = two.select("src", "dst", "q", F.lit(4326).alias("mid"), "p")
    one = one.select("q", "dst", G.reproject_point("p", "src", "mid").alias("d"), "mid").select("q", G.reproject_point("d", "mid", "dst").alias("w"))
    for r in one.collect():
        assert r.q.x == pytest.approx(r.w.x, abs=1e-6) and r.q.y == pytest.approx(r.w.y, abs=1e-6)


@pytest.mark.parametrize("src, dst, rect", [
    (4326, 32632, (3.0, -5.0, 14.0, 8.0)),  # over the central meridian and the equator
    (4326, 32632, (10.0, 40.0, 14.0, 50.0)),
    (32632, 4326, (100000.0, 5_000_000.0, 900000.0, 6_000_000.0)),
    (32732, 4326, (100000.0, 9_500_000.0, 400000.0, 10_400_000.0)),
    (3857, 32632, (500000.0, 5_000_000.0, 1_500_000.0, 7_000_000.0)),
])
def test_boxes_hold_the_whole_image(spark, src, dst, rect):
    x0, y0, x1, y1 = rect
    n = 200
    edge = [(x0 + (x1 - x0) * k / n, y) for k in range(n + 1) for y in (y0, y1)]
    edge += [(x, y0 + (y1 - y0) * k / n) for k in range(n + 1) for x in (x0, x1)]
    image = [r.q for r in _points(spark, [(x, y, src, dst) for x, y in edge]).collect()]
    df = spark.createDataFrame([(*map(float, rect), src, dst)], "xmin double, ymin double, xmax double, ymax double, src int, dst int")
    box = df.select(F.struct("xmin", "ymin", "xmax", "ymax").alias("r"), "src", "dst").select(V.reproject_rect("r", "src", "dst").alias("b")).first().b
    want = (min(q.x for q in image), min(q.y for q in image), max(q.x for q in image), max(q.y for q in image))
    size = max(want[2] - want[0], want[3] - want[1])
    assert box.xmin <= want[0] + 1e-9 * size and box.ymin <= want[1] + 1e-9 * size
    assert box.xmax >= want[2] - 1e-9 * size and box.ymax >= want[3] - 1e-9 * size
    for got, near in zip(box, want, strict=True):
        assert got == pytest.approx(near, abs=1e-4 * size)
