"""Times registered queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_QUERIES a comma list of keys
("all" for every key), BENCH_RUNS the timed runs per query; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyframe.plans.registry import all_queries  # noqa: E402
from tallyframe.session import clear_scratch, local_session  # noqa: E402

HEADLINE = [
    "math_validation", "duplicate_by_hash", "duplicate_by_key", "first_wins", "compliance_issues",
    "vendor_profile", "vendor_anomaly_asof", "validation_status", "replay_requests", "timeline",
    "flatten_header", "source_by_stage", "alerts", "top_vendors", "confidence_trend", "recent_by_source",
    "vendor_stats", "ingest_outcome", "upsert_invoices", "stream_guard",
    "compliance_verdict", "edit_diff", "flatten_lines", "line_items_long", "ingest_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    keys = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, partitions=8, memory="16g")

    def run(key: str) -> float:
        start = time.perf_counter()
        queries[key].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("stage_totals")  # starts the JVM side before anything is timed
    times = {}
    for key in keys:
        times[key] = round(statistics.median(run(key) for _ in range(runs)), 3)
        clear_scratch(spark)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
