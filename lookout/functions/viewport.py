"""Rectangles and the map viewport rule.

Rectangles are ``struct<xmin,ymin,xmax,ymax: double>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import transverse as T
from .geometry import NUMBER, WGS84, _ref, _srid_sql, sql_axis_x, sql_axis_y, sql_separable, sql_supported

# Margin around a non-degenerate extent, default zoom scale.
EXTENT_MARGIN = 1.2
DEFAULT_SCALE = 2000.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rect(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(
        xmin.cast("double").alias("xmin"),
        ymin.cast("double").alias("ymin"),
        xmax.cast("double").alias("xmax"),
        ymax.cast("double").alias("ymax"),
    )


def normalised(r: Column) -> Column:
    """Swap min/max where they are reversed, as a host rectangle does."""
    return F.when(
        r.isNotNull(),
        rect(
            F.least(r["xmin"], r["xmax"]),
            F.least(r["ymin"], r["ymax"]),
            F.greatest(r["xmin"], r["xmax"]),
            F.greatest(r["ymin"], r["ymax"]),
        ),
    )


def sql_bbox_from_text(text: str) -> str:
    # the pattern first: a cast alone would take Java's suffixes, as in "1d"
    nums = (
        f"transform(split({text}, ','), bp -> CASE WHEN trim(bp) RLIKE r'^(?:{NUMBER})$' "
        "THEN try_cast(trim(bp) AS DOUBLE) END)"
    )
    rect_sql = (
        "named_struct('xmin', least(n[0], n[2]), 'ymin', least(n[1], n[3]), "
        "'xmax', greatest(n[0], n[2]), 'ymax', greatest(n[1], n[3]))"
    )
    checked = f"CASE WHEN size(n) = 4 AND forall(n, v -> v IS NOT NULL) THEN {rect_sql} END"
    return f"CASE WHEN {text} IS NOT NULL AND length({text}) > 0 THEN transform(array({nums}), n -> {checked})[0] END"


def bbox_from_text(text: str) -> Column:
    """``"xmin,ymin,xmax,ymax"`` -> rectangle, else null.

    Null or empty text, not exactly four parts, or any part that is not a
    number gives null.  Spaces around the numbers are allowed; swapped
    min/max are normalised.
    """
    return F.expr(sql_bbox_from_text(_ref(text)))


def sql_reproject_rect(r: str, src: str, dst: str) -> str:
    def axes(box: str, one: str, other: str) -> str:
        fields = ", ".join(
            f"'{k}', {(sql_axis_x if k[0] == 'x' else sql_axis_y)(f'{box}.{k}', one, other)}"
            for k in ("xmin", "ymin", "xmax", "ymax")
        )
        return f"named_struct({fields})"

    wgs = str(WGS84)
    inverse = T.sql_box(r, T.sql_inverse("ip", src), "ip", f"{T.FALSE_EASTING!r}D", T.sql_false_northing(src))
    forward = T.sql_box("rd", T.sql_forward("fp", dst), "fp", T.sql_meridian(dst), "0D")
    degrees = f"CASE WHEN {T.sql_is_utm(src)} THEN {inverse} ELSE {axes(r, src, wgs)} END"
    moved = f"CASE WHEN rd IS NULL THEN NULL WHEN {T.sql_is_utm(dst)} THEN {forward} ELSE {axes('rd', wgs, dst)} END"
    return (
        f"CASE WHEN {r} IS NULL OR NOT coalesce({sql_supported(src, dst)}, false) THEN NULL "
        f"WHEN {sql_separable(src, dst)} THEN {axes(r, src, dst)} "
        f"ELSE transform(array({degrees}), rd -> {moved})[0] END"
    )


def reproject_rect(r: str, src: str | int, dst: str | int) -> Column:
    """Rectangle column from ``src`` to ``dst`` (D9): the box of the rectangle's image.

    Where the axes transform separately the two corners give it; from and to a UTM zone it is
    found by the turning points of the edges (``transverse.sql_box``).  Between two zones the box
    of the box in degrees is returned, which holds the image and may be larger.
    """
    return F.expr(sql_reproject_rect(_ref(r), _srid_sql(src), _srid_sql(dst)))


def is_degenerate(r: Column) -> Column:
    """Zero width or zero height."""
    return (r["xmax"] <= r["xmin"]) | (r["ymax"] <= r["ymin"])


def scaled(r: Column, factor: Column, center: Column | None = None) -> Column:
    """Scale width and height by ``factor`` about ``center`` (default: own centre)."""
    cx = center["x"] if center is not None else (r["xmin"] + r["xmax"]) / 2.0
    cy = center["y"] if center is not None else (r["ymin"] + r["ymax"]) / 2.0
    hw = (r["xmax"] - r["xmin"]) * factor / 2.0
    hh = (r["ymax"] - r["ymin"]) * factor / 2.0
    return rect(cx - hw, cy - hh, cx + hw, cy + hh)


def viewport(
    bbox: Column,
    env: Column,
    center: Column,
    map_extent: Column,
    map_scale: Column,
    scale_denom: Column | None = None,
) -> Column:
    """Map extent to show a hit.

    1. a valid bbox (already in map CRS) wins;
    2. else a degenerate envelope (a point, a straight axis-parallel line)
       gets the current map extent scaled by ``scale_denom / map_scale`` and
       centred on the centroid;
    3. else the envelope grown by 1.2 about its centre.
    Null when the hit has no geometry.
    """
    denom = F.coalesce(scale_denom, F.lit(DEFAULT_SCALE)) if scale_denom is not None else F.lit(DEFAULT_SCALE)
    from_scale = scaled(map_extent, denom / map_scale, center)
    grown = scaled(env, F.lit(EXTENT_MARGIN))
    fallback = F.when(env.isNull(), F.lit(None)).when(is_degenerate(env), from_scale).otherwise(grown)
    return F.coalesce(bbox, fallback)
