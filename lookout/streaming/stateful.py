"""Debounce that keeps its own state and its late rows.

``debounce_stream`` lets Spark drop what arrives behind the watermark.  Here the micro-batches run
through ``foreachBatch`` and nothing vanishes: a row behind the watermark goes to a side table.
The state is the one of the batch form: for every session and gap-long time bucket the first time
and the last event.  That decides every event once the watermark has passed its gap, however many
events a bucket had, so a hot session holds (delay + 2 gaps) / gap rows and no more.

State, watermark and outputs of micro-batch n belong to version n + 1 of a versioned folder
(``snapshots``).  A replayed batch starts from the state it started from before and overwrites the
folders it wrote, so a restart neither loses nor repeats a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import MIN_SEARCH_LENGTH
from ..sources import keyed, snapshots
from .debounce import DEFAULT_GAP, _epoch_micros, _interval_micros, accepted

# A watermark that no event reaches: the stream has ended.
_END = (1 << 62) - 1


def _open_state(spark: SparkSession, path: str, batch_id: int) -> tuple[int, str | None, int | None]:
    """Newest version, and state folder and watermark from which ``batch_id`` starts."""
    newest, entries = snapshots.current(spark, f"{path}/state")
    if newest > batch_id:  # a replay
        entries = snapshots.current(spark, f"{path}/state", batch_id)[1] if batch_id else []
    if not entries:
        return newest, None, None
    folder, mark = entries
    return newest, folder, int(mark) if mark != "none" else None


def debounce_batch(
    events: DataFrame,
    path: str,
    batch_id: int,
    gap: str = DEFAULT_GAP,
    *,
    delay: str | None = None,
    session: str = "session_id",
    ts: str = "ts",
    event_id: str = "event_id",
    text: str = "text",
    min_length: int = MIN_SEARCH_LENGTH,
    last: bool = False,
) -> None:
    """Take in micro-batch ``batch_id`` (0, 1, 2, ...) of a stream whose state lives in ``path``.

    An accepted event whose time lies before the watermark, the greatest time of the earlier
    batches less ``delay`` (default: the gap), is late.  Of the others, those survive that
    ``debounce`` keeps of all of them together, whatever batches they came in; each is written
    once the watermark has passed its gap.  ``last`` ends the stream: everything open is decided.
    Rows without a time are dropped, as in the batch form.  A null session is a session.
    """
    spark = events.sparkSession
    gap_us = _interval_micros(gap)
    delay_us = _interval_micros(delay or gap)
    newest, folder, low = _open_state(spark, path, batch_id)
    at = _epoch_micros(ts, events.schema[ts].dataType)
    taken = accepted(events, text, min_length).where(F.col(ts).isNotNull())
    taken = taken.select(F.struct(*[F.col(c) for c in events.columns]).alias("last"), at.alias("at")).persist()
    late = F.col("at") < F.lit(low) if low is not None else F.lit(False)
    top = taken.agg(F.max("at").alias("m")).first()["m"]
    high = max([m for m in (low, None if top is None else top - delay_us) if m is not None], default=None)
    mark = _END if last else high

    bucket = F.floor(F.col("at") / F.lit(gap_us)).cast("long")
    rows = taken.where(~late).select("last", "at", F.col("at").alias("first"), bucket.alias("b"))
    if folder is not None:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/{folder}"))
    roles = F.array(F.struct(F.col("b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("b") - 1).alias("b"), F.lit(False).alias("own")))
    rows = rows.select("last", "at", "first", F.explode(roles).alias("role"))
    own = F.col("role.own")
    newest_first = F.when(own, F.struct(f"last.{ts}", f"last.{event_id}"))
    per = rows.groupBy(F.col(f"last.{session}").alias("s"), F.col("role.b").alias("b")).agg(
        F.max_by("last", newest_first).alias("last"),
        F.max(F.when(own, F.col("at"))).alias("at"),
        F.min(F.when(own, F.col("first"))).alias("first"),
        F.min(F.when(~own, F.col("first"))).alias("next"),
    )
    ends = F.col("at") + F.lit(gap_us)
    decided = ends < F.lit(mark) if mark is not None else F.lit(False)
    survives = F.col("next").isNull() | (F.col("next") > ends)
    status = F.when(~decided, "open").when(survives, "kept")
    found = per.where(F.col("first").isNotNull()).withColumn("status", status).where(F.col("status").isNotNull())
    step = f"step-{uuid.uuid4().hex}"
    found.drop("s", "next").write.mode("error").partitionBy("status").parquet(f"{path}/{step}")

    whole = spark.read.schema(found.drop("s", "next").schema).parquet(f"{path}/{step}")
    kept = whole.where("status = 'kept'").select("last.*")
    kept.write.mode("overwrite").parquet(f"{path}/debounced/batch_id={batch_id}")
    taken.where(late).select("last.*").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
    taken.unpersist()
    if newest <= batch_id:
        state = f"{step}/status=open"
        if whole.where("status = 'open'").isEmpty():  # no folder of that name was written
            state = f"{step}-open"
            whole.limit(0).select("last", "at", "first", "b").coalesce(1).write.mode("error").parquet(f"{path}/{state}")
        snapshots.publish(spark, f"{path}/state", batch_id + 1, [state, "none" if mark is None else str(mark)])


def read_debounced(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The events that survived so far, one row each."""
    return spark.read.schema(schema).parquet(f"{path}/debounced").select(*schema.names)


def read_late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The accepted events that came behind the watermark, and the batch they came in."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{path}/late")


def start_debounce_sink(
    events: DataFrame,
    path: str,
    gap: str = DEFAULT_GAP,
    *,
    checkpoint_location: str,
    trigger: dict | None = None,
    **columns,
) -> StreamingQuery:
    """Run a stream of events through ``debounce_batch`` (its other arguments go in ``columns``)."""

    def take(batch: DataFrame, batch_id: int) -> None:
        debounce_batch(batch, path, batch_id, gap, **columns)

    writer = events.writeStream.option("checkpointLocation", checkpoint_location).foreachBatch(take)
    return (writer.trigger(**trigger) if trigger else writer).start()


def start_latest_sink(
    events: DataFrame,
    path: str,
    *,
    checkpoint_location: str,
    session: str = "session_id",
    ts: str = "ts",
    event_id: str = "event_id",
    text: str = "text",
    min_length: int = MIN_SEARCH_LENGTH,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the text that every session currently shows in a keyed table (C3, ``read_keyed``).

    The table is the state: a session is remembered however long it rests, rows that come out of
    order never replace newer ones, and a replayed batch is skipped.
    """
    rows = accepted(events, text, min_length).select(session, ts, event_id, text)

    def take(batch: DataFrame, batch_id: int) -> None:
        keyed.upsert(batch, path, [session], [ts, event_id], batch_id=batch_id)

    writer = rows.writeStream.option("checkpointLocation", checkpoint_location).foreachBatch(take)
    return (writer.trigger(**trigger) if trigger else writer).start()
