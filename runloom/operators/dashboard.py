"""Dashboard questions answered from the hourly statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from runloom.functions.time import Window, label, trunc, ts

# Fixed value: the largest top list a dashboard asks for.
TOP_QUEUES = 20


def in_window(rollup: DataFrame, window: Window) -> DataFrame:
    """Buckets of a window, both ends included."""
    return rollup.filter((F.col("bucket_start") >= ts(window.start)) & (F.col("bucket_start") <= ts(window.end)))


def totals(runs: DataFrame, rollup: DataFrame, window: Window) -> DataFrame:
    """Live running and waiting counts next to finished counts of the window."""
    live = runs.filter(F.col("status").isin("active", "waiting")).agg(
        F.count_if(F.col("status") == "active").alias("running_tasks"),
        F.count_if(F.col("status") == "waiting").alias("waiting_in_queue"),
    )
    closed = in_window(rollup, window).agg(
        F.sum("completed_runs").alias("successes"), F.sum("failed_runs").alias("failures")
    )
    names = ["running_tasks", "waiting_in_queue", "successes", "failures"]
    both = live.unionByName(closed, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])


def _ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(otherwise))


def queue_performance(rollup: DataFrame, window: Window) -> DataFrame:
    """Runs, error rate and duration per queue, re-aggregated from hours."""
    hours = in_window(rollup, window).groupBy("queue").agg(
        F.sum("total_runs").alias("total_runs"),
        F.sum("completed_runs").alias("successes"),
        F.sum("failed_runs").alias("failures"),
        F.sum("duration_total_ms").alias("_total_ms"),
        F.sum("duration_count").alias("_timed"),
        F.min("duration_min_ms").alias("_min_ms"),
        F.max("duration_max_ms").alias("_max_ms"),
    )
    seconds = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") / F.lit(1000)
    return hours.select(
        "queue",
        "total_runs",
        "successes",
        "failures",
        (_ratio(F.col("failures"), F.col("total_runs")) * 100).alias("error_rate"),
        (_ratio(F.col("_total_ms"), F.col("_timed")) / 1000).alias("avg_duration"),
        seconds("_min_ms").alias("min_duration"),
        seconds("_max_ms").alias("max_duration"),
    )


def sort_performance(performance: DataFrame, key: str = "total_runs", direction: str = "desc") -> DataFrame:
    """Performance table by any of its columns; equal rows by queue name."""
    if key not in performance.columns:
        raise ValueError(f"not a performance column: {key}")
    order = F.col(key).asc() if direction == "asc" else F.col(key).desc()
    return performance.orderBy(order, F.col("queue").asc())


def top_by_count(performance: DataFrame, limit: int = 10) -> DataFrame:
    """Queues with the most runs."""
    ranked = performance.select("queue", F.col("total_runs").alias("run_count"))
    return ranked.orderBy(F.col("run_count").desc(), F.col("queue")).limit(_top(limit))


def top_by_duration(performance: DataFrame, limit: int = 10) -> DataFrame:
    """Queues with the longest average duration, those without any left out."""
    ranked = performance.filter(F.col("avg_duration") > 0).select("queue", F.col("avg_duration").alias("total_duration"))
    return ranked.orderBy(F.col("total_duration").desc(), F.col("queue")).limit(_top(limit))


def _top(limit: int) -> int:
    if not 1 <= limit <= TOP_QUEUES:
        raise ValueError(f"limit must lie between 1 and {TOP_QUEUES}")
    return limit


def calendar(frame: DataFrame, start: datetime, end: datetime, step: Column, name: str) -> DataFrame:
    """Every row of ``frame`` once per step of the range, both ends included."""
    return frame.withColumn(name, F.explode(F.sequence(ts(start), ts(end), step)))


def run_graph(rollup: DataFrame, window: Window) -> DataFrame:
    """Runs per hour or day with empty steps shown as zero."""
    bucket = F.col("bucket_start")
    counts = (
        in_window(rollup, window)
        .groupBy(trunc(window.grain, bucket).alias("_step"))
        .agg(F.sum("total_runs").alias("run_count"))
    )
    # The steps of a window are known before reading anything: at most 31 days
    # of days or 8 days of hours.
    steps = calendar(rollup.sparkSession.range(1), window.start, window.end, window.step, "_step")
    return steps.join(counts, "_step", "left").select(
        label(F.col("_step")).alias("timestamp"),
        F.coalesce("run_count", F.lit(0)).cast("long").alias("run_count"),
    )


def pressure_per_queue(rollup: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Mean wait per finished run over a half-open range of hours, rounded half up."""
    if start is not None:
        rollup = rollup.filter(F.col("bucket_start") >= ts(start))
    if end is not None:
        rollup = rollup.filter(F.col("bucket_start") < ts(end))
    total = F.sum("pressure_total_ms").cast("decimal(20,0)")
    count = F.nullif(F.sum("pressure_count"), F.lit(0)).cast("decimal(20,0)")
    return rollup.groupBy("queue").agg(F.round(total / count).cast("long").alias("pressure"))
