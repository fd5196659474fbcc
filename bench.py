"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
Each query runs once to warm up and then BENCH_RUNS times (default 3) into a noop sink; the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.plans.catalog import QUERIES
from tidemark.session import build_session

HEADLINE = [
    "rolling_costs_provider", "rolling_costs_total", "rolling_costs_role", "cost_report", "lifetime_savings",
    "first_success", "failure_streaks", "provider_health",
    "quality_score", "scrubbed_text", "safety_verdicts", "secret_inventory",
    "canonical_responses", "payload_context", "committed_memories", "run_summary",
    "rule_facts", "search_batch", "term_frequencies", "memory_stats",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, sf_dir, name)
        seconds[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline queries, sum of medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
