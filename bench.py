"""Headline queries on the given tables; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2; the best run counts), BENCH_QUERIES (comma-separated subset).
"""

from __future__ import annotations

import json
import os
import sys
import time

from spinelens.plans.queries import QUERIES
from spinelens.session import local_session

HEADLINE = [
    "metrics_wide", "metrics_long", "measurements_long", "metrics_normalised",
    "metrics_from_measurements", "detection_overview", "audit_samples", "audit_summary",
    "missing_by_label", "top_incomplete_poly", "selection_counts", "four_corners", "pose_rows",
    "adaptive_box", "merge_labels", "merge_stats", "pairing_missing", "class_distribution",
    "format_violations", "overlay_edges", "detections_normalised", "prediction_stats",
    "evaluation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
