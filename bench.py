"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "ingest_records", "ingest_failure_rate", "evaluate_incidents", "evaluate_with_tools", "dispatch_actions",
    "metrics_summary", "daily_score_trend", "rolling_score_by_workflow", "latency_summary", "window_report_nested",
    "window_prompt_lines", "faithfulness", "similar_incidents", "rag_evaluate", "rate", "alert_latency",
    "alert_error_ratio", "health_report", "rolling_health", "cooldown_alerts", "similar_in_last", "route_incidents",
    "snapshot_versions", "validate_test_cases", "stream_window_summary",
)


def main() -> None:
    from faultline.plans import QUERIES
    from faultline.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in HEADLINE if len(sys.argv) < 2 or n in sys.argv[1:]]
    spark = local_session("faultline-bench", os.environ.get("BENCH_CPUS", "8"))
    # the first scan of a session pays for start-up, not the queries
    spark.read.parquet(f"{folder}/events.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(folder.rstrip("/"))}
    if times.get("ingest_records"):
        out["evaluations_per_sec"] = round(rows / times["ingest_records"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
