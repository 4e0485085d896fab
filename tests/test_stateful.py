"""Debounce with state and late rows, keyed upserts, restarts."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lookout import SearchConfig, debounce, start_search_stream
from lookout.operators import postings
from lookout.sources import snapshots
from lookout.sources.keyed import read_keyed, upsert
from lookout.streaming.stateful import (
    debounce_batch,
    read_debounced,
    read_late,
    start_debounce_sink,
    start_latest_sink,
)

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
SCHEMA = "session_id long, ts timestamp, event_id long, text string"


def events(spark, rows):
    return spark.createDataFrame([(s, t if t is None else T0 + dt.timedelta(seconds=t), e, x) for s, t, e, x in rows], SCHEMA)


def _rows(n, seed):
    rnd = random.Random(seed)
    # a slowly rising clock with stragglers; one session has most events, some have none
    return [
        (rnd.choice([1, 1, 1, 2, None]), None if k % 50 == 7 else k * 0.125 - rnd.choice([0, 0, 0.25, 1, 4]), k, rnd.choice(["ab", "abc", "xyz"]))
        for k in range(n)
    ]


def test_equals_batch_form_of_all_rows_in_time(spark, scratch):
    rows, path, delay, gap = _rows(240, 3), f"{scratch}/d", 2.0, 0.5
    sizes, top, in_time, late, at = [70, 1, 0, 90, 79], None, [], set(), 0
    for batch, size in enumerate(sizes):
        part = rows[at : at + size]
        at += size
        mark = None if top is None else top - delay
        for r in part:
            if r[1] is not None and len(r[3]) >= 3:
                late.add((r[2], batch)) if mark is not None and r[1] < mark else in_time.append(r)
                top = r[1] if top is None else max(top, r[1])
        debounce_batch(events(spark, part), path, batch, "500 milliseconds", delay="2 seconds", last=batch == 4)
    schema = events(spark, []).schema
    want = {tuple(r) for r in debounce(events(spark, in_time), "500 milliseconds").collect()}
    got = [tuple(r) for r in read_debounced(spark, path, schema).collect()]
    assert len(got) == len(want) and set(got) == want
    assert late and {(r.event_id, r.batch_id) for r in read_late(spark, path, schema).collect()} == late


def test_replayed_batch_changes_nothing(spark, scratch):
    path, rows = f"{scratch}/d", _rows(120, 5)
    schema = events(spark, []).schema

    def both():
        return sorted(map(str, read_debounced(spark, path, schema).collect())), sorted(map(str, read_late(spark, path, schema).collect()))

    for k in range(3):
        debounce_batch(events(spark, rows[k * 40 : k * 40 + 40]), path, k)
    first = both()
    for k in (1, 2):  # as after a crash that lost the stream's own note of these batches
        debounce_batch(events(spark, rows[k * 40 : k * 40 + 40]), path, k)
    assert both() == first and snapshots.current(spark, f"{path}/state")[0] == 3


def test_hot_session_holds_a_row_a_bucket(spark, scratch):
    path = f"{scratch}/d"
    rows = [(1, k * 0.001, k, "abc") for k in range(4000)]
    debounce_batch(events(spark, rows), path, 0, "500 milliseconds", delay="1 second")
    folder = snapshots.current(spark, f"{path}/state")[1][0]
    assert spark.read.parquet(f"{path}/{folder}").count() <= 4


def test_stream_restarts_without_loss_or_repeat(spark, scratch):
    src, path, seen = f"{scratch}/in", f"{scratch}/d", []
    latest = f"{scratch}/latest"
    schema = events(spark, []).schema
    for k, rows in enumerate([_rows(60, 1), [(2, 500.0, 900, "later"), (1, 1.0, 901, "too late")], [(9, 900.0, 902, "flush")]]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        for start, folder in ((start_debounce_sink, path), (start_latest_sink, latest)):
            q = start(
                spark.readStream.schema(SCHEMA).parquet(src), folder,
                checkpoint_location=f"{folder}-ckpt", trigger={"availableNow": True},
            )
            assert q.awaitTermination(120) and q.exception() is None
        seen += rows
    found = {r.event_id for r in read_debounced(spark, path, schema).collect()}
    late = {r.event_id for r in read_late(spark, path, schema).collect()}
    assert late == {901} and 900 in found and 902 not in found
    want = {}
    for s, t, e, x in seen:
        if len(x) >= 3 and (s not in want or (t is not None, t or 0, e) > want[s][0]):
            want[s] = ((t is not None, t or 0, e), x)
    assert {r.session_id: r.text for r in read_keyed(spark, latest).collect()} == {s: x for s, (_, x) in want.items()}


KEYED = "k long, at long, v string, gone boolean"


def test_upsert_order_deletion_and_replay(spark, scratch):
    path = f"{scratch}/t"
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(30)]), rnd.randint(0, 99) * 1000 + i, f"v{i}", rnd.random() < 0.2) for i in range(400)]
    want = {}
    for n, lo in enumerate(range(0, 400, 100)):
        part = rows[lo : lo + 100]
        version = upsert(spark.createDataFrame(part, KEYED), path, ["k"], ["at"], deleted="gone", buckets=7, batch_id=n)
        assert version == n + 1
        for r in part:
            if r[0] not in want or r[1] > want[r[0]][1]:
                want[r[0]] = r
        assert {r.k: tuple(r) for r in read_keyed(spark, path).collect()} == {k: r for k, r in want.items() if not r[3]}
    assert upsert(spark.createDataFrame([(1, 10**9, "again", False)], KEYED), path, ["k"], ["at"], batch_id=3) == 4
    assert read_keyed(spark, path, 1).count() < read_keyed(spark, path).count() + 30
    with pytest.raises(ValueError, match="other keys"):
        upsert(spark.createDataFrame([(1, 2)], "k long, at long"), path, ["k"], ["at"])


def test_upsert_rewrites_only_the_buckets_it_touches(spark, scratch):
    path = f"{scratch}/t"
    upsert(spark.range(1000).selectExpr("id AS k", "0 AS at", "'a' AS v"), path, ["k"], ["at"], buckets=16)
    before = set(snapshots.current(spark, path)[1])
    upsert(spark.sql("SELECT 5L AS k, 1 AS at, 'b' AS v"), path, ["k"], ["at"])
    after = set(snapshots.current(spark, path)[1])
    assert len(after - before) == 1 and len(before - after) == 1
    assert read_keyed(spark, path).where("v = 'b'").count() == 1 and read_keyed(spark, path).count() == 1000


def test_upsert_of_nothing(spark, scratch):
    empty = spark.createDataFrame([], KEYED)
    assert upsert(empty, f"{scratch}/t", ["k"], ["at"], deleted="gone") == 1
    assert read_keyed(spark, f"{scratch}/t").count() == 0
    with pytest.raises(ValueError, match="no column"):
        upsert(empty, f"{scratch}/u", ["nope"], ["at"])


def test_search_stream_reads_the_newest_index(spark, scratch):
    cfg = SearchConfig(search_column="name", tie_break=("key",), extra_columns=("key",), limit=5)
    index, src, out = f"{scratch}/index", f"{scratch}/in", f"{scratch}/out"
    table = spark.range(300).selectExpr("id AS key", "concat('Red Ring ', id) AS name")
    postings.build(table.where("key < 100"), cfg, index)

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        q = start_search_stream(
            spark.readStream.schema(SCHEMA).parquet(src), index, cfg, out,
            checkpoint_location=f"{scratch}/ckpt", trigger={"availableNow": True},
        )
        assert q.awaitTermination(120) and q.exception() is None
        return {(r.event_id, r.key, r.index_version) for r in spark.read.parquet(out).collect()}

    assert run([(1, 0.0, 1, "ring 25"), (1, 50.0, 2, "ring 25"), (3, 60.0, 3, "flush")]) == {(1, 25, 1), (2, 25, 1)}
    postings.append(table.where("key >= 100"), cfg, index)
    got = run([(1, 100.0, 4, "ring 25"), (3, 200.0, 5, "flush")])
    assert {g for g in got if g[0] == 4} == {(4, k, 2) for k in (25, 125, 225, 250, 251)}
