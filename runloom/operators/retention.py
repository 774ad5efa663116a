"""Deleting what has outlived its retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from runloom.functions.time import naive_utc, ts

ROLLUP_RETENTION = timedelta(days=30)


def keep_since(table: DataFrame, column: str, as_of: datetime, retention: timedelta | None) -> DataFrame:
    """Rows a retention delete leaves; without a retention nothing is deleted."""
    if retention is None:
        return table
    return table.filter(F.col(column) >= ts(naive_utc(as_of) - retention))


def expired(table: DataFrame, column: str, as_of: datetime, retention: timedelta) -> DataFrame:
    return table.filter(F.col(column) < ts(naive_utc(as_of) - retention))


def keep_runs(runs: DataFrame, as_of: datetime, retention: timedelta | None) -> DataFrame:
    return keep_since(runs, "created_at", as_of, retention)


def keep_logs(logs: DataFrame, runs: DataFrame, as_of: datetime, retention: timedelta | None) -> DataFrame:
    """Log lines after their runs were deleted: they go with the run."""
    if retention is None:
        return logs
    gone = expired(runs, "created_at", as_of, retention).select(F.col("id").alias("job_run_id"))
    return logs.join(gone, "job_run_id", "left_anti")


def keep_rollup(rollup: DataFrame, as_of: datetime, retention: timedelta = ROLLUP_RETENTION) -> DataFrame:
    return keep_since(rollup, "bucket_start", as_of, retention)


def keep_tags(tags: DataFrame, as_of: datetime, retention: timedelta | None) -> DataFrame:
    return keep_since(tags, "last_seen_at", as_of, retention)
