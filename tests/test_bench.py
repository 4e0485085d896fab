"""bench.py stays runnable: every headline query executes, one JSON line out."""

import json
import os
import subprocess
import sys

import bench

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_bench_query_runs(spark):
    assert len(bench.QUERIES) >= 8
    for name, fn in bench.QUERIES.items():
        bench.run(fn(spark, SF_SMALL))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py"), "search_documents", "debounce"],
        capture_output=True, text=True, env=env, timeout=600, check=True,
    ).stdout.strip().splitlines()
    assert len(out) == 1
    doc = json.loads(out[0])
    assert doc["unit"] == "sec" and set(doc["queries"]) == {"search_documents", "debounce"}
    assert doc["value"] == round(sum(doc["queries"].values()), 3)
