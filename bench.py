"""Benchmark of the headline jobs; prints one JSON line.

Every job runs once to warm up and then three times; the median counts. A
query's time covers building its plan and computing all of its rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from liftwise.session import local_session
from workload import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "a2_flag_evaluations",
    "a7_event_tables",
    "c1_attributed_events",
    "d1_first_exposure",
    "d4_variant_stats",
    "d9_event_daily",
    "d12_balanced_sampling",
    "f1_query_experiment_sum",
    "i1_bayesian_comparison",
    "i5_bandit_weights",
    "i9_bayesian_result",
    "c8_conflict_counts",
]


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
