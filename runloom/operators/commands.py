"""Cancelling, replaying, pausing and deleting in bulk, from frames of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runloom.functions.status import is_terminal
from runloom.functions.text import queue_name_candidates

# Options a replayed job does not inherit.
NOT_REPLAYED = ["delay", "jobId", "repeat", "repeatJobKey", "timestamp"]


def resolve_queue_names(names: DataFrame, queues: DataFrame, column: str = "queue_name") -> DataFrame:
    """Stored name for each requested one: the exact name, else its brace variant, else NULL."""
    asked = names.select(column).distinct()
    tried = asked.select(column, F.posexplode(queue_name_candidates(F.col(column))).alias("_rank", "name"))
    known = tried.join(queues.select("name", F.lit(True).alias("_known")), "name", "left")
    rank = F.when(F.col("_known").isNotNull(), F.col("_rank"))
    return known.groupBy(column).agg(F.min_by("name", rank).alias("resolved"))


def _resolved(commands: DataFrame, queues: DataFrame) -> DataFrame:
    return commands.join(resolve_queue_names(commands, queues), "queue_name", "left")


def cancel_jobs(commands: DataFrame, runs: DataFrame, queues: DataFrame) -> DataFrame:
    """Outcome of each cancellation, one row per run it meets.

    Every run is judged by its own status: a finished run is left alone even
    where another run of the same job is cancelled.
    """
    wanted = _resolved(commands.select("queue_name", "job_id").distinct(), queues)
    stored = runs.select("id", F.col("queue").alias("resolved"), "job_id", "status", "error_message")
    met = wanted.join(stored, ["resolved", "job_id"], "left")
    outcome = (
        F.when(F.col("resolved").isNull(), F.lit("queue_not_found"))
        .when(F.col("id").isNull(), F.lit("job_not_found"))
        .when(is_terminal(F.col("status")), F.lit("already_finished"))
        .otherwise(F.lit("cancelled"))
    )
    done = outcome == "cancelled"
    return met.select(
        "queue_name", "job_id", "id", outcome.alias("outcome"),
        F.when(done, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.when(done, F.lit("Job cancelled")).otherwise(F.col("error_message")).alias("error_message"),
    )


def set_paused(commands: DataFrame, queues: DataFrame, paused: bool) -> DataFrame:
    """The queue table after pausing or resuming the commanded queues."""
    targets = resolve_queue_names(commands, queues).filter(F.col("resolved").isNotNull())
    hit = targets.select(F.col("resolved").alias("name"), F.lit(True).alias("_hit")).distinct()
    flag = F.when(F.col("_hit").isNotNull(), F.lit(paused)).otherwise(F.col("is_paused"))
    return queues.join(hit, "name", "left").withColumn("is_paused", flag).select(*queues.columns)


def delete_queues(commands: DataFrame, queues: DataFrame, schedulers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queues and schedulers that remain; schedulers go with their queue."""
    gone = resolve_queue_names(commands, queues).select(F.col("resolved").alias("name"))
    ids = queues.join(gone, "name", "left_semi").select(F.col("id").alias("queue_id"))
    return queues.join(gone, "name", "left_anti").select(*queues.columns), schedulers.join(ids, "queue_id", "left_anti")


def replay_rows(jobs: DataFrame) -> DataFrame:
    """Jobs to enqueue again, from rows with name, data and the options as JSON."""
    options = F.from_json("opts", "map<string,variant>")
    kept = F.map_filter(options, lambda k, _: ~k.isin(NOT_REPLAYED))
    return jobs.select("queue", "name", "data", F.to_json(kept).alias("opts"))


def replay_set(commands: DataFrame, jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """Re-enqueue rows of the jobs the commands pick."""
    wanted = _resolved(commands.select("queue_name", "job_id").distinct(), queues)
    keys = wanted.filter(F.col("resolved").isNotNull()).select(F.col("resolved").alias("queue"), "job_id").distinct()
    return replay_rows(jobs.join(keys, ["queue", "job_id"], "left_semi"))


def enqueue_messages(jobs: DataFrame) -> DataFrame:
    """Jobs as JSON payloads keyed by queue, ready for a message sink."""
    body = F.struct(
        "queue", "name",
        F.try_parse_json("data").alias("data"),
        F.try_parse_json("opts").alias("opts"),
    )
    return jobs.select(F.col("queue").alias("key"), F.to_json(body).alias("value"))
