"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS (default 3): each query runs
once to warm up, then BENCH_RUNS times; the median counts.  Results go to Spark's noop sink, so every row and
column is computed.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "intensity_outcomes", "window_counts", "window_distinct", "sender_metrics", "receiver_metrics", "edge_degrees",
    "longest_streak", "active_day_counts", "exposure_metrics", "responses_after", "user_mart", "d3_mart",
    "active_peers", "daily_edges", "duplicate_audit", "quantiles", "outlier_profile", "segment_clusters", "lift",
    "roc_auc", "dedup", "spearman", "three_axis_mart", "outcome_summary",
]


def main() -> None:
    from daymark.catalog import load
    from daymark.session import local

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cpus = os.environ.get("BENCH_CPUS", "*")
    names = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local("daymark-bench", cores=cpus, partitions=8 if cpus == "*" else max(2, int(cpus)))
        queries, times = load().queries, {}
        for name in names:
            spent = []
            for _ in range(runs + 1):
                start = time.perf_counter()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                spent.append(time.perf_counter() - start)
            times[name] = round(statistics.median(spent[1:]), 4)
            print(name, times[name], [round(x, 2) for x in spent], file=sys.stderr, flush=True)
        spark.stop()
    total = round(sum(times.values()), 4)
    print(json.dumps({"metric": "sum of median query seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
