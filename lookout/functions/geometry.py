"""Geometry columns on hits, as native Spark expressions.

Geometry travels as WKT text plus an integer SRID.  Spark's own geometry type
has no WKT, envelope or centroid functions, so coordinates are read from the
text with ``regexp_extract_all`` and folded with higher-order functions
(``transform``, ``zip_with``, ``aggregate``).  Nothing leaves the JVM.

The expressions are written as Spark SQL text (``sql_*`` builders taking SQL
snippets) and wrapped with ``F.expr``: one parse per expression instead of
thousands of Python-to-JVM calls to assemble the same tree with the Column
API.  The Column wrappers take column names.

Coordinate arrays are ``array<struct<x:double,y:double>>``; parts (line
strings, polygon rings) are ``array<array<...>>`` with a parallel boolean
array marking the first (exterior) ring of every polygon.  Z and M ordinates
are read past and dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import transverse as T

# ---------------------------------------------------------------------------
# Fixed values.
# A WKT number, and one coordinate group "x y [z [m]]".
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
COORD = rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*"
# An innermost parenthesised coordinate list, with the run of "(" before it:
# a non-empty group 1 marks the first ring of a polygon.
PART = r"((?:\(\s*)*)\(([^()]*)\)"
# Geometry type word at the start (optionally after an EWKT "SRID=n;").
TYPE_WORD = r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)"
POINT_TYPES = ("POINT", "MULTIPOINT")
LINE_TYPES = ("LINESTRING", "MULTILINESTRING")
POLYGON_TYPES = ("POLYGON", "MULTIPOLYGON")
# WGS 84 and its spherical (web) Mercator; the sphere radius of EPSG:3857.
WGS84 = 4326
WEB_MERCATOR = 3857
EARTH_RADIUS = 6378137.0
# ---------------------------------------------------------------------------

POINT_TYPE = "struct<x:double,y:double>"
_DEG = math.pi / 180.0


def _d(v: float) -> str:
    """A double literal in SQL text."""
    return f"{float(v)!r}D"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def q(name: str) -> str:
    """SQL reference to a column name."""
    return "`" + name.replace("`", "``") + "`"


def _ref(c: Column | str) -> str:
    if isinstance(c, str):
        return q(c)
    raise TypeError("geometry functions take column names; select the value into a column first")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# --------------------------------------------------------------------------- D1


def sql_coords(text: str) -> str:
    """All coordinates of a WKT text (or of one part of it); empty when none."""
    pts = (
        f"zip_with(regexp_extract_all({text}, r'{COORD}', 1), regexp_extract_all({text}, r'{COORD}', 2), "
        f"(cx, cy) -> named_struct('x', CAST(cx AS DOUBLE), 'y', CAST(cy AS DOUBLE)))"
    )
    return f"coalesce({pts}, CAST(array() AS array<{POINT_TYPE}>))"


def sql_parts(wkt: str) -> str:
    """Coordinate lists of every line string / ring: ``array<array<point>>``."""
    parts = f"transform(regexp_extract_all({wkt}, r'{PART}', 2), pt -> {sql_coords('pt')})"
    return f"coalesce({parts}, CAST(array() AS array<array<{POINT_TYPE}>>))"


def sql_exterior(wkt: str) -> str:
    """Parallel to :func:`sql_parts`: true for the first ring of each polygon."""
    flags = f"transform(regexp_extract_all({wkt}, r'{PART}', 1), o -> o != '')"
    return f"coalesce({flags}, CAST(array() AS array<boolean>))"


def wkt_coords(wkt: str) -> Column:
    return F.expr(sql_coords(_ref(wkt)))


def wkt_parts(wkt: str) -> Column:
    return F.expr(sql_parts(_ref(wkt)))


def wkt_exterior_flags(wkt: str) -> Column:
    return F.expr(sql_exterior(_ref(wkt)))


# --------------------------------------------------------------------------- D2


def sql_srid_from_authid(authid: str) -> str:
    code = f"regexp_extract({authid}, r'^EPSG:(\\d+)$', 1)"
    return f"CASE WHEN {code} != '' THEN try_cast({code} AS INT) END"


def srid_from_authid(authid: str) -> Column:
    """``EPSG:27700`` -> 27700; any other authority -> null (D2, DEC-6)."""
    return F.expr(sql_srid_from_authid(_ref(authid)))


# --------------------------------------------------------------------------- D3


def sql_geometry_type(wkt: str) -> str:
    return f"regexp_replace(upper(regexp_extract({wkt}, r'{TYPE_WORD}', 1)), r'(ZM|Z|M)$', '')"


def sql_geom_class(wkt: str, parts: str) -> str:
    """``point`` / ``line`` / ``polygon`` / ``unknown`` from the text and its parts."""
    t = sql_geometry_type(wkt)
    return (
        f"CASE WHEN {wkt} IS NULL OR size(flatten({parts})) = 0 THEN 'unknown' "
        f"WHEN {t} IN ({_in(POINT_TYPES)}) THEN 'point' "
        f"WHEN {t} IN ({_in(LINE_TYPES)}) THEN 'line' "
        f"WHEN {t} IN ({_in(POLYGON_TYPES)}) THEN 'polygon' ELSE 'unknown' END"
    )


def geometry_type(wkt: str) -> Column:
    return F.expr(sql_geometry_type(_ref(wkt)))


def geom_class(wkt: str) -> Column:
    """``point`` / ``line`` / ``polygon`` / ``unknown`` (D3).

    Null, unparsable, EMPTY and collection geometries are ``unknown``: the hit
    is kept but gets no map work.
    """
    ref = _ref(wkt)
    return F.expr(sql_geom_class(ref, sql_parts(ref)))


def display_kind(cls: Column | str) -> Column:
    """Marker at the centroid for points, outline for lines and polygons."""
    cls = F.col(cls) if isinstance(cls, str) else cls
    return F.when(cls == "point", F.lit("marker")).when(cls.isin("line", "polygon"), F.lit("outline"))


# --------------------------------------------------------------------------- D5


def sql_envelope(pts: str) -> str:
    """Bounding rectangle of a coordinate array; null when empty."""
    return (
        f"CASE WHEN size({pts}) > 0 THEN named_struct("
        f"'xmin', array_min(transform({pts}, p -> p.x)), 'ymin', array_min(transform({pts}, p -> p.y)), "
        f"'xmax', array_max(transform({pts}, p -> p.x)), 'ymax', array_max(transform({pts}, p -> p.y))) END"
    )


def envelope(coords: str) -> Column:
    return F.expr(sql_envelope(_ref(coords)))


# --------------------------------------------------------------------------- D6

_STATS = ("len", "lx", "ly", "w", "wx", "wy")


def sql_part_stats(parts: str, exterior: str) -> str:
    """Per-part length and area moments, one pass over each part's segments.

    Areas are taken relative to the part's first point for precision; a
    ring's weight is +|area| for the first ring of a polygon and -|area| for
    holes, whatever the ring orientation.
    """
    segs = (
        "zip_with(slice(pts, 1, greatest(size(pts) - 1, 0)), slice(pts, 2, greatest(size(pts) - 1, 0)), "
        "(a, b) -> named_struct('a', a, 'b', b))"
    )
    x0 = "try_element_at(pts, 1).x"
    y0 = "try_element_at(pts, 1).y"
    seg = "sqrt((s.b.x - s.a.x) * (s.b.x - s.a.x) + (s.b.y - s.a.y) * (s.b.y - s.a.y))"
    cross = f"((s.a.x - {x0}) * (s.b.y - {y0}) - (s.b.x - {x0}) * (s.a.y - {y0}))"
    zero = ", ".join(f"'{k}', 0D" for k in ("len", "lx", "ly", "a2", "mx", "my"))
    step = (
        f"named_struct('len', acc.len + {seg}, "
        f"'lx', acc.lx + {seg} * (s.a.x + s.b.x) / 2D, "
        f"'ly', acc.ly + {seg} * (s.a.y + s.b.y) / 2D, "
        f"'a2', acc.a2 + {cross}, "
        f"'mx', acc.mx + (s.a.x + s.b.x - 2D * {x0}) * {cross}, "
        f"'my', acc.my + (s.a.y + s.b.y - 2D * {y0}) * {cross})"
    )
    weight = "(CASE WHEN ext THEN 1D ELSE -1D END * abs(t.a2) / 2D)"
    safe = "(CASE WHEN t.a2 != 0 THEN t.a2 END)"
    finish = (
        f"named_struct('len', t.len, 'lx', t.lx, 'ly', t.ly, 'w', {weight}, "
        f"'wx', coalesce({weight} * ({x0} + t.mx / (3D * {safe})), 0D), "
        f"'wy', coalesce({weight} * ({y0} + t.my / (3D * {safe})), 0D))"
    )
    return (
        f"zip_with({parts}, {exterior}, (pts, ext) -> "
        f"aggregate({segs}, named_struct({zero}), (acc, s) -> {step}, t -> {finish}))"
    )


def sql_total(stats: str, parts: str) -> str:
    """Sum of the part moments plus the point count and coordinate sums."""
    zero = ", ".join(f"'{k}', 0D" for k in _STATS)
    add = ", ".join(f"'{k}', acc.{k} + e.{k}" for k in _STATS)
    summed = f"aggregate({stats}, named_struct({zero}), (acc, e) -> named_struct({add}))"
    coords = (
        f"aggregate(flatten({parts}), named_struct('sx', 0D, 'sy', 0D), "
        f"(acc, p) -> named_struct('sx', acc.sx + p.x, 'sy', acc.sy + p.y))"
    )
    # bind both folds once through a one-element transform, then flatten them
    fields = ", ".join(f"'{k}', v.m.{k}" for k in _STATS)
    return (
        f"transform(array(named_struct('m', {summed}, 'c', {coords})), v -> named_struct({fields}, "
        f"'n', size(flatten({parts})), 'sx', v.c.sx, 'sy', v.c.sy))[0]"
    )


def sql_centroid(cls: str, total: str) -> str:
    """Centroid as GEOS computes it (D6), from :func:`sql_total`.

    point: mean of the points; line: length-weighted mean of segment
    midpoints; polygon: area-weighted ring centroids, holes subtracting.  A
    polygon of zero area falls back to the line rule and a line of zero
    length to the point rule.
    """
    t = total
    mean = f"named_struct('x', {t}.sx / {t}.n, 'y', {t}.sy / {t}.n)"
    by_length = f"named_struct('x', {t}.lx / {t}.len, 'y', {t}.ly / {t}.len)"
    by_area = f"named_struct('x', {t}.wx / {t}.w, 'y', {t}.wy / {t}.w)"
    line_or_mean = f"CASE WHEN {t}.len > 0 THEN {by_length} ELSE {mean} END"
    return (
        f"CASE WHEN {t} IS NULL OR {t}.n IS NULL OR {t}.n <= 0 THEN NULL "  # size(null) is -1 without ANSI
        f"WHEN {cls} = 'point' THEN {mean} "
        f"WHEN {cls} = 'line' THEN {line_or_mean} "
        f"WHEN {cls} = 'polygon' THEN CASE WHEN {t}.w != 0 THEN {by_area} ELSE {line_or_mean} END END"
    )


def part_stats(parts: str, exterior: str) -> Column:
    return F.expr(sql_part_stats(_ref(parts), _ref(exterior)))


def total_stats(stats: str, parts: str) -> Column:
    return F.expr(sql_total(_ref(stats), _ref(parts)))


def centroid_from_stats(cls: str, total: str) -> Column:
    return F.expr(sql_centroid(_ref(cls), _ref(total)))


def centroid(cls: str, parts: str, exterior: str) -> Column:
    """One-expression form; :func:`lookout.operators.hits.with_geometry` stages
    the same pieces as separate columns so each is computed once per row."""
    p = _ref(parts)
    return F.expr(sql_centroid(_ref(cls), sql_total(sql_part_stats(p, _ref(exterior)), p)))


# --------------------------------------------------------------------------- D7


def _sql_known(srid: str) -> str:
    return f"({srid} IN ({WGS84}, {WEB_MERCATOR}) OR {T.sql_is_utm(srid)})"


def sql_supported(src: str, dst: str) -> str:
    """True when ``src -> dst`` has a closed form here (identity; among 4326, 3857 and the UTM zones)."""
    return (
        f"({src} IS NOT NULL AND {dst} IS NOT NULL AND "
        f"({src} = {dst} OR ({_sql_known(src)} AND {_sql_known(dst)})))"
    )


def sql_separable(src: str, dst: str) -> str:
    """True when the axes of a supported pair transform one by one."""
    return f"({src} = {dst} OR NOT ({T.sql_is_utm(src)} OR {T.sql_is_utm(dst)}))"


def sql_axis_x(v: str, src: str, dst: str) -> str:
    """x (longitude / easting) from ``src`` to ``dst``; the axes are separable."""
    fwd = f"{v} * {_d(_DEG)} * {_d(EARTH_RADIUS)}"
    inv = f"{v} / {_d(EARTH_RADIUS)} * {_d(1.0 / _DEG)}"
    return f"CASE WHEN {src} = {dst} THEN {v} WHEN {src} = {WGS84} THEN {fwd} ELSE {inv} END"


def sql_axis_y(v: str, src: str, dst: str) -> str:
    """y (latitude / northing) from ``src`` to ``dst``."""
    fwd = f"ln(tan({_d(math.pi / 4.0)} + {v} * {_d(math.pi / 360.0)})) * {_d(EARTH_RADIUS)}"
    inv = f"(2D * atan(exp({v} / {_d(EARTH_RADIUS)})) - {_d(math.pi / 2.0)}) * {_d(1.0 / _DEG)}"
    return f"CASE WHEN {src} = {dst} THEN {v} WHEN {src} = {WGS84} THEN {fwd} ELSE {inv} END"


def sql_axes(p: str, src: str, dst: str) -> str:
    return f"named_struct('x', {sql_axis_x(p + '.x', src, dst)}, 'y', {sql_axis_y(p + '.y', src, dst)})"


def sql_through_degrees(p: str, src: str, dst: str) -> str:
    """From or to a UTM zone, by longitude and latitude."""
    degrees = f"CASE WHEN {T.sql_is_utm(src)} THEN {T.sql_inverse(p, src)} ELSE {sql_axes(p, src, str(WGS84))} END"
    moved = f"CASE WHEN {T.sql_is_utm(dst)} THEN {T.sql_forward('gd', dst)} ELSE {sql_axes('gd', str(WGS84), dst)} END"
    return f"transform(array({degrees}), gd -> {moved})[0]"


def sql_reproject_point(p: str, src: str, dst: str) -> str:
    return (
        f"CASE WHEN NOT coalesce({sql_supported(src, dst)}, false) THEN NULL "
        f"WHEN {sql_separable(src, dst)} THEN {sql_axes(p, src, dst)} "
        f"ELSE {sql_through_degrees(p, src, dst)} END"
    )


def sql_reproject_parts(parts: str, src: str, dst: str) -> str:
    """Every coordinate of every part; null when the pair is not supported."""
    moved = f"transform({parts}, rp -> transform(rp, rq -> {sql_reproject_point('rq', src, dst)}))"
    return f"CASE WHEN {sql_supported(src, dst)} THEN {moved} END"


def _srid_sql(v: Column | str | int) -> str:
    return str(int(v)) if isinstance(v, int) else _ref(v)


def supported_transform(src: str | int, dst: str | int) -> Column:
    return F.expr(sql_supported(_srid_sql(src), _srid_sql(dst)))


def reproject_point(p: str, src: str | int, dst: str | int) -> Column:
    """One point column from ``src`` to ``dst`` SRID; null when not supported."""
    return F.expr(sql_reproject_point(_ref(p), _srid_sql(src), _srid_sql(dst)))


def reproject_parts(parts: str, src: str | int, dst: str | int) -> Column:
    return F.expr(sql_reproject_parts(_ref(parts), _srid_sql(src), _srid_sql(dst)))
