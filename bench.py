"""Time the headline queries and print one line of JSON.

Each query is run once to warm up and then timed writing to a sink that
discards rows, so that every column of every row is computed.
"""

from __future__ import annotations

import json
import logging
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hourly_rollup", "hourly_rollup_refresh", "rollup_backfill_merge", "rollup_touched_hours",
    "dashboard_totals", "queue_performance", "run_graph_hour", "run_graph_day", "top_queues_count",
    "queue_pressure", "queues_page_waiting", "queues_page_pressure", "queue_names_page", "queue_chart",
    "system_overview", "job_stats", "last_status_per_queue", "last_run_data",
    "jobs_page_created_next", "jobs_page_duration", "jobs_search_text", "jobs_by_tags", "jobs_created_range",
    "job_detail", "jobs_by_key", "job_logs_page", "logs_dedupe", "logs_sequence", "log_timeline",
    "tag_catalogue", "parse_job_events", "parse_log_events", "fold_per_event", "fold_last_in_batch",
    "upsert_job_runs", "upsert_changed_rows", "logs_resolved", "buffer_drain", "queue_snapshot_diff",
    "scheduler_snapshot_diff", "reconcile_live", "reconcile_unknown", "stalled_sweep", "cancel_jobs",
    "replay_set", "retention_logs", "replication_audit", "stream_fold", "stream_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    rounds = int(os.environ.get("BENCH_ROUNDS", "1"))

    from runloom.session import local_session

    logging.disable(logging.CRITICAL)
    spark = local_session(cpus, cpus)
    from runloom.plans.catalog import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(rounds)), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
