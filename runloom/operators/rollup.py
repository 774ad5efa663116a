"""Hourly per-queue statistics of job runs and their maintenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from runloom.functions.status import is_terminal
from runloom.functions.time import DAY, HOUR, duration_ms, floor_to, is_stored_instant, naive_utc, trunc, ts, wait_ms
from runloom.operators.pruning import created_between

PRESSURE_COLUMNS = ["pressure_total_ms", "pressure_count", "updated_at"]


def measures(as_of: datetime) -> list[Column]:
    status = F.col("status")
    # A run that carries the generated column keeps it; others compute it.
    timed = F.when(status == "completed", F.col("duration_ms"))
    waited = F.when(is_terminal(status), wait_ms())
    return [
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(status == "completed").alias("completed_runs"),
        F.count_if(status == "failed").alias("failed_runs"),
        F.count_if(status == "active").alias("active_runs"),
        F.count_if(status == "waiting").alias("waiting_runs"),
        F.coalesce(F.sum(timed.cast("long")), F.lit(0)).cast("long").alias("duration_total_ms"),
        F.count(timed).alias("duration_count"),
        F.min(timed).alias("duration_min_ms"),
        F.max(timed).alias("duration_max_ms"),
        F.coalesce(F.sum(waited), F.lit(0)).cast("long").alias("pressure_total_ms"),
        F.count(waited).alias("pressure_count"),
        ts(as_of).alias("updated_at"),
    ]


def with_duration(runs: DataFrame) -> DataFrame:
    return runs if "duration_ms" in runs.columns else runs.withColumn("duration_ms", duration_ms())


def hourly_rollup(runs: DataFrame, as_of: datetime) -> DataFrame:
    """One row per (created hour, queue).

    Statuses outside the four counted ones appear in the total only. Durations
    are those of completed runs, pressure that of finished runs. One shuffle of
    partial aggregates, so a busy queue costs no more than a quiet one.
    """
    keys = [trunc("hour", F.col("created_at")).alias("bucket_start"), F.col("queue")]
    return with_duration(runs).groupBy(*keys).agg(*measures(as_of))


def refresh_hour(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Statistics of the last closed hour before ``as_of``."""
    end = floor_to("hour", as_of)
    return hourly_rollup(created_between(runs, end - HOUR, end), as_of)


def backfill(runs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Statistics of every hour of the last ``days`` days."""
    return hourly_rollup(created_between(runs, naive_utc(as_of) - days * DAY, None), as_of)


def replace_hour(stored: DataFrame, fresh: DataFrame, bucket: datetime) -> DataFrame:
    """The stored table with one bucket replaced as a whole."""
    return stored.filter(F.col("bucket_start") != ts(bucket)).unionByName(fresh)


def merge_columns(stored: DataFrame, fresh: DataFrame, replaced: list[str] | None = None) -> DataFrame:
    """Upsert by (bucket, queue) that overwrites only the ``replaced`` measures.

    With no list every measure is replaced. Both sides hold a key once, so the
    outer join has no hot keys.
    """
    keys = ["bucket_start", "queue"]
    columns = [c for c in stored.columns if c not in keys]
    replaced = columns if replaced is None else replaced
    old = stored.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_old"))
    new = fresh.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))

    def pick(c: str) -> Column:
        use_new = F.col("_new").isNotNull() if c in replaced else F.col("_old").isNull()
        return F.when(use_new, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)

    return old.join(new, keys, "full_outer").select(*keys, *[pick(c) for c in columns])


def backfill_pressure(stored: DataFrame, runs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Back-fill that adds missing buckets but touches only pressure in stored ones."""
    return merge_columns(stored, backfill(runs, as_of, days), PRESSURE_COLUMNS)


def refresh_touched(runs: DataFrame, changed: DataFrame, as_of: datetime) -> DataFrame:
    """Recompute every hour in which a changed run was created.

    A bucket computed once goes stale when its runs finish later; this repairs
    it. ``changed`` needs ``created_at`` only. Its hours are few, one per hour of
    the calendar at most, and are sent to every task so that the runs stay where
    they are; stored runs are read from the dates of those hours only.
    """
    hour = trunc("hour", F.col("created_at")).alias("_hour")
    bounded = changed.filter(is_stored_instant(F.col("created_at")))
    hours = bounded.select(hour, F.to_date("created_at").alias("created_date")).distinct()
    on = ["_hour", "created_date"] if "created_date" in runs.columns else ["_hour"]
    touched = runs.withColumn("_hour", hour).join(F.broadcast(hours.select(*on)), on, "left_semi")
    return hourly_rollup(touched.drop("_hour"), as_of)
