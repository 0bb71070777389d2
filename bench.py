"""Benchmark: headline pipelines at one scale factor, one JSON line on stdout.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEAT (default 2; the best run of each query is reported),
     BENCH_DRIVER_MEMORY (default 4g; local mode runs in the driver JVM),
     BENCH_WARMUP (default 1; untimed passes over all queries first, so JIT
     compilation and codegen caches are warm as in a long-running session).
Each query is executed in full with the ``noop`` sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regspark.plans.catalog import QUERIES  # noqa: E402
from regspark.session import get_spark  # noqa: E402

HEADLINE = [
    "status_by_pan",                # flagship: J3 + A1-A5
    "map_pans_pan_data",            # Q1, PAN table
    "map_pans_gstin_data",          # Q1, GSTIN table
    "update_details",               # Q2, table after the details run
    "update_details_outcomes",      # Q2, per-id outcomes
    "enrich_left",                  # Q3
    "ingest_pages_results",         # Q5, result pages -> items
    "ingest_pages_status",          # Q5 -> A4
    "ingest_pages_details",         # Q5, detail pages -> details
    "extract_details_alt",          # X8
    "stream_apply_results",         # T1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="regspark-bench",
                      driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "4g"))
    spark.sparkContext.setLogLevel("ERROR")
    warmup = int(os.environ.get("BENCH_WARMUP", "1"))
    for _ in range(warmup):
        for name in HEADLINE:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    from regspark.fixtures import fixture
    sheet_rows = fixture(spark, sf_dir, "pan_sheet").count()
    q1 = times["map_pans_pan_data"] + times["map_pans_gstin_data"]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_pipelines_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "q1_pans_per_sec": round(sheet_rows / q1, 1) if q1 else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
