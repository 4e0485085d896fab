"""Versioned folders: a table made of parts, and a pointer that names the parts of each version.

Writers add parts under names of their own and then publish a version.  The pointer of a version
is one small file that appears by one rename, so a reader sees a version whole or not at all, and
two writers of the same version cannot both succeed.  Parts of older versions stay until somebody
removes them; readers that opened an older version are not disturbed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("part string, at int, version long").parquet(f"{path}/pointer")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str]]:
    """The newest version (or the given one) and its parts, oldest first; (0, []) for a new folder."""
    pointers = _pointers(spark, path)
    if pointers is None:
        return 0, []
    if version is None:
        version = pointers.agg(F.max("version").alias("v")).first()["v"]
        if version is None:
            return 0, []
    rows = pointers.where(F.col("version") == version).select("part", "at").collect()  # a few parts a version
    if not rows:
        raise ValueError(f"{path} has no version {version}")
    return version, [r["part"] for r in sorted(rows, key=lambda r: r["at"]) if r["part"]]


def publish(spark: SparkSession, path: str, version: int, parts: list[str]) -> None:
    """Make ``parts`` the content of ``version``; an error if that version exists."""
    rows = [(p, k) for k, p in enumerate(parts)] or [("", 0)]
    one = spark.createDataFrame(rows, "part string, at int").coalesce(1)
    one.write.mode("error").parquet(f"{path}/pointer/version={version}")
