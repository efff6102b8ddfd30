"""Benchmark one dashboard refresh from the raw tables at $BENCH_SF_DIR on local[$BENCH_CPUS].

0. ``warmup``: one trivial job on made-up rows (JVM class loading, codegen start-up); reported
   separately as ``warmup_sec`` and not part of ``value``.
1. ``build_views``: derive and materialise the panel, its periods and the parent/child view in a checkpoint folder of
   this run's own (always measured, never reused from an earlier run).
2. ``page_load``: every registered result of the dashboard. The statement results are computed once and shared;
   independent results are submitted concurrently ($BENCH_WORKERS at a time), as a dashboard refresh would.
3. ``cold``: afterwards every result once more by itself, one at a time, from the derived tables, nothing shared or
   cached. Not part of ``value``.

Prints one JSON line; ``value`` = build_views + page_load wall seconds. ``queries`` holds each result's cold seconds,
``shared`` its latency inside the page load (these overlap when workers > 1).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    workers = int(os.environ.get("BENCH_WORKERS", "4"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ladder-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.default.parallelism", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ladder-bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from ladder.plans.dashboard import run_all, shared_statements
    from ladder.plans.queries import QUERIES
    from ladder.sources import views
    from ladder.sources.run import Run

    tw = time.perf_counter()
    spark.range(1000).selectExpr("sum(id) AS s").collect()
    warmup = time.perf_counter() - tw

    t0 = time.perf_counter()
    views.build_views(spark, sf_dir, workers=2)
    views.panel_periods(spark, sf_dir)
    build = time.perf_counter() - t0

    shared: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, run, into):
        def action():
            t = time.perf_counter()
            rows[name] = len(QUERIES[name](spark, run).collect())
            into[name] = time.perf_counter() - t
        return action

    names = list(QUERIES)
    t1 = time.perf_counter()
    with shared_statements(spark, sf_dir) as run:
        run_all([timed(name, run, shared) for name in names], workers)
    page_load = time.perf_counter() - t1
    cold: dict[str, float] = {}
    run_all([timed(name, Run(sf_dir), cold) for name in names])

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "dashboard_refresh_sec",
        "value": round(build + page_load, 3),
        "unit": "sec",
        "warmup_sec": round(warmup, 3),
        "build_views_sec": round(build, 3),
        "page_load_sec": round(page_load, 3),
        "queries": {k: round(cold[k], 3) for k in names},
        "shared": {k: round(shared[k], 3) for k in names},
        "rows": rows,
        "n_results": len(names),
        "workers": workers,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
