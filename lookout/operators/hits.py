"""Geometry and viewport for every hit.

The reference computes these for the one hit a person picks; here they are
columns over the whole hit set, one narrow projection (no shuffle), so they
scale with the executors like the scan does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import viewport as V

_PARTS = "__lookout_parts"
_RAW = "__lookout_raw_parts"
_EXT = "__lookout_exterior"
_STATS = "__lookout_stats"
_BBOX = "__lookout_bbox_src"
_TOTAL = "__lookout_total"


def with_geometry(
    hits: DataFrame,
    dst_srid: int | None = None,
    geom: str = "geom",
    srid: str = "epsg",
) -> DataFrame:
    """Add ``geom_class``, ``display_kind``, ``reprojection_supported``,
    ``envelope`` and ``centroid``; envelope and centroid are in ``dst_srid``
    (the source SRID when ``dst_srid`` is None).

    The work is staged over narrow projections (parts -> per-part moments ->
    totals -> centroid) so that every array fold runs once per row; Catalyst
    does not merge a projection into its consumer when that would repeat an
    expensive expression.
    """
    dst = srid if dst_srid is None else int(dst_srid)
    stage1 = hits.select(
        "*",
        G.wkt_parts(geom).alias(_RAW),
        G.wkt_exterior_flags(geom).alias(_EXT),
        (G.supported_transform(srid, dst) if dst_srid is not None else F.lit(True)).alias("reprojection_supported"),
    )
    parts = G.reproject_parts(_RAW, srid, dst) if dst_srid is not None else F.col(_RAW)
    cls = F.expr(G.sql_geom_class(G.q(geom), G.q(_RAW)))
    stage2 = stage1.select(*hits.columns, "reprojection_supported", cls.alias("geom_class"), parts.alias(_PARTS), _EXT)
    stage3 = stage2.select("*", G.part_stats(_PARTS, _EXT).alias(_STATS))
    stage3 = stage3.select("*", G.total_stats(_STATS, _PARTS).alias(_TOTAL))
    known = F.col("geom_class") != F.lit("unknown")
    return stage3.select(
        *[F.col(c) for c in hits.columns],
        "geom_class",
        G.display_kind(F.col("geom_class")).alias("display_kind"),
        "reprojection_supported",
        F.when(known, F.expr(G.sql_envelope(f"flatten({G.q(_PARTS)})"))).alias("envelope"),
        F.when(known, G.centroid_from_stats("geom_class", _TOTAL)).alias("centroid"),
    )


def with_viewport(
    hits: DataFrame,
    map_extent: Sequence[float],
    map_scale: float,
    dst_srid: int,
    *,
    geom: str = "geom",
    srid: str = "epsg",
    bbox_text: str | None = "bbox_text",
    scale_denom: str | None = "scale_denom",
) -> DataFrame:
    """Geometry columns plus ``bbox`` and ``viewport`` in ``dst_srid``.

    ``map_extent`` (xmin, ymin, xmax, ymax) and ``map_scale`` describe the
    current map in ``dst_srid``.  ``bbox_text`` / ``scale_denom`` name the
    columns produced by the config's bbox / scale expressions (E1); missing
    columns mean "no expression".
    """
    geo = with_geometry(hits, dst_srid, geom=geom, srid=srid)
    if bbox_text and bbox_text in hits.columns:
        geo = geo.select("*", V.bbox_from_text(bbox_text).alias(_BBOX))
        bbox = V.reproject_rect(_BBOX, srid, int(dst_srid))
        geo = geo.select(*[c for c in geo.columns if c != _BBOX], bbox.alias("bbox"))
    else:
        bbox = F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
        geo = geo.select("*", bbox.alias("bbox"))
    scale: Column | None = F.col(scale_denom) if scale_denom and scale_denom in hits.columns else None
    extent = V.rect(*[F.lit(float(v)) for v in map_extent])
    view = V.viewport(F.col("bbox"), F.col("envelope"), F.col("centroid"), extent, F.lit(float(map_scale)), scale)
    known = (F.col("geom_class") != F.lit("unknown")) & F.col("reprojection_supported")
    return geo.select("*", F.when(known, view).alias("viewport"))
