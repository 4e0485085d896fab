"""Shared folder, written intermediate tables and table readers.

Lineage is cut by writing a table into the folder that ``spark.checkpoint.dir``
names, so a lost executor costs a reread, never a wrong or missing row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster must set ``spark.checkpoint.dir``.  Only a single-process local
    session (tests) falls back to a scratch folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="lookout-llm-")
    return _LOCAL["dir"]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{label}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task numbers at most, on average.
ROWS_PER_CHUNK = 50_000
#: Offset rows (24 bytes) that are broadcast at most.
MAX_OFFSETS = 200_000


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """``df`` with a gapless number from 0 within each group, however large the group is.

    Rows are dealt into hashed chunks of about ``ROWS_PER_CHUNK`` rows; a row's number is its
    place in the chunk plus the sizes of the group's chunks before it.  ``rows`` is the row
    count of ``df``, which should be a written table.  The order is by chunk, then by ``order``.
    """
    chunks = max(1, -(-rows // ROWS_PER_CHUNK))
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    sizes = written(df.groupBy(*groups, "_chunk").agg(F.count("*").alias("_size")), "sizes")
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    offsets = F.broadcast(offsets) if sizes.count() <= MAX_OFFSETS else offsets.hint("merge")
    place = F.row_number().over(Window.partitionBy(*groups, "_chunk").orderBy(*order)) - 1
    out = df.withColumn("_place", place).join(offsets, [*groups, "_chunk"])
    return out.withColumn(name, (F.col("_place") + F.col("_offset")).cast("long")).drop("_chunk", "_place", "_offset")


#: Ids (8 bytes each) that are broadcast at most.
MAX_IDS = 1_000_000


def _ids(ids: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids for a join: broadcast up to ``MAX_IDS``."""
    ids = written(ids.select(F.col(ids.columns[0]).alias(id_col)).where(F.col(id_col).isNotNull()).distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= MAX_IDS else ids.hint("merge")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of the given ids; rows with a null id stay.

    Up to ``MAX_IDS`` ids are broadcast, so texts do not move; more are met in a shuffled join.
    """
    return docs.join(_ids(ids, id_col), id_col, "left_anti").select(*docs.columns)


def within(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one of the given ids, met as in ``without``."""
    return docs.join(_ids(ids, id_col), id_col, "left_semi").select(*docs.columns)
