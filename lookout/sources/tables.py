"""Relation scan and hit sink.

``read_source`` turns a config into a DataFrame; ``write_hits`` stores a hit set.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..config import SearchConfig
from ..functions.patterns import literal_runs_text, wildcard_pattern_text
from .jdbc import JDBC_TYPES, jdbc_options


def read_source(spark: SparkSession, cfg: SearchConfig, text: str | None = None) -> DataFrame:
    """The searchable relation of ``cfg`` (A1-A3); unknown types are an error (DEC-5).

    With the ``text`` of one search, the source may leave out rows that cannot match it; the
    GeoPackage reader does so in the file, by bound parameters.

    Only the columns a search references are read: Catalyst pushes the search's
    projection into the parquet or JDBC scan.  The GeoPackage reader gets the
    attributes that the config names.
    """
    kind = cfg.data_type
    if kind == "parquet":
        if not cfg.path:
            raise ValueError("parquet source needs path")
        return spark.read.parquet(cfg.path)
    if kind == "table":
        if not cfg.table:
            raise ValueError("table source needs table")
        return spark.table(f"{cfg.schema}.{cfg.table}" if cfg.schema else cfg.table)
    if kind in JDBC_TYPES:
        return spark.read.format("jdbc").options(**jdbc_options(cfg)).load()
    if kind == "gpkg":
        from .gpkg import register

        register(spark)
        layer = cfg.layer or cfg.table
        if not cfg.path or not layer:
            raise ValueError("gpkg source needs path and layer")
        full = spark.read.format("gpkg").option("layer", layer).load(cfg.path).schema
        if cfg.scale_expr is None and cfg.bbox_expr is None:  # an expression may use any attribute
            named = {*cfg.required_columns, *cfg.extra_columns}
            full = StructType(full.fields[:4] + [f for f in full.fields[4:] if f.name in named])
        reader = spark.read.format("gpkg").option("layer", layer).schema(full)
        if text is not None:
            runs = literal_runs_text(wildcard_pattern_text(text, cfg.escape_spec_chars, cfg.backslash))
            reader = reader.option("matchColumn", cfg.search_column).option("matchParts", json.dumps(runs))
        return reader.load(cfg.path)
    raise ValueError(f"config {cfg.name!r}: data_type {kind!r} has no reader; pass a DataFrame")


def write_hits(
    hits: DataFrame,
    *,
    path: str | None = None,
    table: str | None = None,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Store a hit set as files or as a catalog table."""
    if (path is None) == (table is None):
        raise ValueError("give exactly one of path or table")
    writer = hits.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer.save(path)
    else:
        writer.saveAsTable(table)
