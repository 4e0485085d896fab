"""A table that holds the latest row of every key, changed by upserts.

Keys are dealt into a fixed number of buckets by hash.  An upsert reduces the changes to one row a
key, rewrites the buckets that they touch and publishes a version (``snapshots``); the other
buckets' files are named again as they are.  The row of the greatest ``order`` wins wherever it
comes from, so late and repeated changes do no harm, and a batch that the newest version already
holds is not applied again.  A deletion is a row too: it stays as a mark, so that an older change
that arrives later does not bring the key back, and readers do not see it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir
from . import snapshots

BUCKETS = 64
_BUCKET = "__lk_bucket"


def _state(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, str], dict[int, str]]:
    """Version, its notes (``#name=value``) and the folder of every bucket that has rows."""
    found, entries = snapshots.current(spark, path, version)
    notes = dict(e[1:].split("=", 1) for e in entries if e.startswith("#"))
    parts = {int(e.rsplit("=", 1)[1]): e for e in entries if not e.startswith("#")}
    return found, notes, parts


def _latest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of the greatest ``order`` for every ``by``; equal ones by the hash of the whole row."""
    rank = F.struct(*order, F.xxhash64(*columns))
    last = F.max_by(F.struct(*columns), rank).alias("__lk_row")
    return df.groupBy(*[F.col(c).alias(f"__lk_by{k}") for k, c in enumerate(by)]).agg(last).select("__lk_row.*")


def upsert(
    changes: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    *,
    deleted: str | None = None,
    buckets: int = BUCKETS,
    batch_id: int | None = None,
) -> int:
    """Apply ``changes`` to the table in ``path`` and return the version that holds them.

    ``order`` (nulls lowest) decides which row of a key stays.  ``deleted`` names a boolean column
    that marks deletions.  A ``batch_id`` that is not above the one of the newest version was
    applied before and is skipped.  A null key is a key.  ``buckets`` counts for a new table only:
    a bucket is rewritten by one task, so choose it such that a bucket is a few hundred megabytes.
    Changes of another schema than the table's are an error.
    """
    spark = changes.sparkSession
    ensure_checkpoint_dir(spark)
    version, notes, parts = _state(spark, path)
    if batch_id is not None and int(notes.get("batch", -1)) >= batch_id:
        return version
    columns = changes.columns
    if missing := [c for c in [*keys, *order, *([deleted] if deleted else [])] if c not in columns]:
        raise ValueError(f"changes have no column {missing}")
    given = ",".join(keys), ",".join(order), changes.schema.simpleString()
    if notes and given != (notes["keys"], notes["order"], StructType.fromJson(json.loads(notes["schema"])).simpleString()):
        raise ValueError(f"{path} has other keys, order or columns than these changes")
    buckets = int(notes.get("buckets", buckets))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    # one row a key before anything moves to its bucket: a hot key costs a row a task
    new = _latest(changes, keys, order, columns).withColumn(_BUCKET, bucket).checkpoint(eager=True)
    touched = sorted(r[_BUCKET] for r in new.select(_BUCKET).distinct().collect())  # at most ``buckets``
    if touched:
        frames = [new]
        if old := [f"{path}/{parts[b]}" for b in touched if b in parts]:
            frames.append(spark.read.schema(changes.schema).parquet(*old).withColumn(_BUCKET, bucket))
        whole = reduce(DataFrame.unionByName, frames).repartition(buckets, _BUCKET)
        # rows of one key lie together already: no further shuffle
        merged = _latest(whole, [_BUCKET, *keys], order, columns).withColumn(_BUCKET, bucket)
        folder = f"data-{uuid.uuid4().hex}"
        merged.withColumnRenamed(_BUCKET, "bucket").write.mode("error").partitionBy("bucket").parquet(f"{path}/{folder}")
        parts.update({b: f"{folder}/bucket={b}" for b in touched})
    about = {"keys": given[0], "order": given[1], "schema": changes.schema.json(), "buckets": buckets}
    about |= {"deleted": deleted or notes.get("deleted", ""), "batch": notes.get("batch", -1) if batch_id is None else batch_id}
    snapshots.publish(spark, path, version + 1, [*[f"#{k}={v}" for k, v in about.items()], *[parts[b] for b in sorted(parts)]])
    return version + 1


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row a key, as of the newest version or the given one; deleted keys are left out."""
    found, notes, parts = _state(spark, path, version)
    if not found:
        raise ValueError(f"no table in {path}")
    schema = StructType.fromJson(json.loads(notes["schema"]))
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{parts[b]}" for b in sorted(parts)])
    return rows.where(~F.coalesce(F.col(notes["deleted"]), F.lit(False))) if notes["deleted"] else rows
