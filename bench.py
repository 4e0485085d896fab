"""Benchmark the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
(default 8) and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full into Spark's ``noop`` sink (no collect, no
column pruning beyond what the query itself needs).  A warm-up pass over
sf0.001 runs first so JIT and session start-up are not billed to the first
query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lookout import SearchConfig, batch_search, search  # noqa: E402
from lookout.plans import catalog as C  # noqa: E402
from lookout.plans import fixtures as X  # noqa: E402
from lookout.session import local_session  # noqa: E402

DOCS = SearchConfig(
    name="documents",
    search_column="text",
    tie_break=("doc_id",),
    display_columns=("lang", "source"),
    echo_search_column=False,
    extra_columns=("doc_id",),
)


def q_search_documents(spark, d):
    """One search over every document's whole text, top 1000."""
    return search(X.load(spark, d, "documents"), "the and of", DOCS)


def q_search_documents_rare(spark, d):
    """A selective search over every whole text."""
    return search(X.load(spark, d, "documents"), "quer ion", DOCS)


def q_batch_geocode_blocked(spark, d):
    """B15 blocked: one look-up string per customer against all places."""
    return C.batch_geocode(spark, d)


def q_batch_documents_blocked(spark, d):
    """B15 blocked: every distinct part name searched in every whole document text."""
    queries = X.load(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS query_id", "p_name AS text", "5 AS k")
    return batch_search(X.load(spark, d, "documents"), queries, DOCS, strategy="blocked")


def q_batch_edge_scan(spark, d):
    """B15 scan strategy: the edge-case strings against part in one pass."""
    return C.batch_search_scan(spark, d)


def q_debounce(spark, d):
    return C.debounce_events(spark, d)


def q_debounce_search(spark, d):
    return C.debounce_search_q(spark, d)


def q_viewport(spark, d):
    return C.viewport_q(spark, d)


def q_multi_config(spark, d):
    return C.multi_config(spark, d)


QUERIES = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="lookout-bench")
    names = [n for n in QUERIES if not only or n in only]
    for name in names:  # warm-up
        run(QUERIES[name](spark, "/root/testdata/sf0.001"))
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
