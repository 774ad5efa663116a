"""Micro-batch ingestion of job and log messages.

Each trigger reduces its messages to mergeable fold states or deduplicated log
lines and writes them under the number of the batch. Writing a batch again
replaces it, so redelivery after a failure is harmless, and no trigger rewrites
what earlier ones stored. Reading folds the states, and :func:`compact` folds
them into fewer from time to time; or each batch is merged into a runs table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators import logs as lines
from runloom.operators.upsert import (
    change_feed,
    fold_states,
    last_in_batch,
    merge_states,
    runs_of_states,
    upsert_changes,
    within_retention,
)
from runloom.schemas import BUFFER_KEY
from runloom.session import shared_dir, spread
from runloom.sources.messages import parse_job_messages, parse_log_messages, rejected_rows, valid_rows
from runloom.sources.tables import BATCH, delete, exists, upsert_table, write_batch
from runloom.sources.versions import Versioned


def _start(stream: DataFrame, handle, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_jobs(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    as_of: datetime,
    retention: timedelta | None = None,
    semantics: str = "per_event",
    once: bool = True,
    table: str | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Fold a stream of job messages into states under ``path/states``.

    Refused messages go to ``path/rejects``. With ``table`` each batch is merged
    into that runs table instead, of which only the dates of the batch are read,
    and what it changed goes to ``path/changes``; then neither the work of a batch
    nor what is kept beside the table grows with what was stored before. ``partitions`` deals each batch over so
    many tasks.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_job_messages(spread(batch, partitions)).persist()
        try:
            events = valid_rows(parsed)
            if retention is not None:
                events = within_retention(events, as_of, retention)
            if semantics == "last_in_batch":
                events = last_in_batch(events.withColumn(BATCH, F.lit(batch_id)), BATCH).drop(BATCH)
            states = fold_states(events)
            if table is not None:
                changes = upsert_table(table, runs_of_states(states))
                write_batch(change_feed(changes), f"{path}/changes", batch_id)
            else:
                write_batch(states, f"{path}/states", batch_id)
            write_batch(rejected_rows(parsed), f"{path}/rejects", batch_id)
        finally:
            parsed.unpersist()

    return _start(messages, handle, checkpoint, once)


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/states")


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs as of the last batch written."""
    return runs_of_states(merge_states(stored_states(spark, path)))


def compact(states: DataFrame, path: str) -> None:
    """Merge states of many batches into one table of states, at a new place."""
    merge_states(states).write.mode("errorifexists").parquet(path)


def changes_of_batch(runs: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids and statuses that a batch of parsed events changes in the runs table."""
    return change_feed(upsert_changes(runs, runs_of_states(fold_states(batch))))


def ingest_logs(
    messages: DataFrame,
    runs: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    as_of: datetime,
    once: bool = True,
    partitions: int | None = None,
) -> StreamingQuery:
    """Resolve a stream of log messages against the runs table.

    ``runs`` is called for each batch, because a frame keeps the list of files
    that it was made with and would not see later runs.

    Lines of known runs go to ``path/logs``, the others to ``path/buffer`` until
    a drain finds their run. Both are keyed by batch; copies of a line that span
    batches are dropped on reading by identity.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_log_messages(spread(batch, partitions)).persist()
        events = lines.first_of_each(valid_rows(parsed), BUFFER_KEY, "seq")
        attached = lines.attach_runs(events, runs())
        try:
            attached.persist()
            write_batch(lines.resolved(attached), f"{path}/logs", batch_id)
            waiting = lines.unresolved(attached, as_of).withColumn(BATCH, F.lit(batch_id))
            _buffer(batch.sparkSession, path).replace(waiting, [str(batch_id)])
            write_batch(rejected_rows(parsed), f"{path}/rejects", batch_id)
        finally:
            attached.unpersist()
            parsed.unpersist()

    return _start(messages, handle, checkpoint, once)


def current_logs(spark: SparkSession, path: str) -> DataFrame:
    """Stored lines, each identity once: that of its earliest batch."""
    stored = spark.read.parquet(f"{path}/logs")
    return lines.first_of_each(stored, lines.LOG_KEY, BATCH).select(*lines.LOG_COLUMNS)


def _buffer(spark: SparkSession, path: str) -> Versioned:
    return Versioned(spark, f"{path}/buffer", BATCH)


def drain_buffer(spark: SparkSession, path: str, runs: DataFrame, batch_id: int | None = None) -> None:
    """Move waiting lines whose run has arrived to the logs.

    Lines are written before the buffer is cut down to the rest, which happens
    in one step; a drain that stopped in between is repeated and writes the same
    lines again, which reading drops by identity. Ingestion may go on meanwhile:
    its batches are partitions of the buffer that this drain has not seen and
    leaves alone.

    The lines go under a number of the drain's own: a negative one made from the
    version of the buffer, or ``batch_id``, which must not be taken.
    """
    buffer = _buffer(spark, path)
    seen = buffer.current()
    if seen is None:
        return
    number = -1 - seen.number if batch_id is None else batch_id
    if batch_id is not None and exists(spark, f"{path}/logs/{BATCH}={batch_id}"):
        raise ValueError(f"batch {batch_id} is stored already")
    staged = shared_dir(spark, "buffer")
    waiting = buffer.read(at=seen)
    lines.attach_runs(waiting, runs).write.parquet(staged)
    attached = spark.read.parquet(staged)
    write_batch(lines.resolved(lines.first_of_each(attached, BUFFER_KEY, BATCH)), f"{path}/logs", number)
    rest = attached.filter(F.col("job_run_id").isNull()).select(*seen.schema.names)
    buffer.replace(rest, list(seen.folders), seen=seen)
    delete(spark, staged)


def current_buffer(spark: SparkSession, path: str) -> DataFrame:
    """Waiting lines, each identity once."""
    return lines.first_of_each(_buffer(spark, path).read(), BUFFER_KEY, BATCH).drop(BATCH)


def distinct_lines(events: DataFrame, late_by: str) -> DataFrame:
    """A log stream without repeated lines that arrive within ``late_by`` of each other.

    Watermarks need a zoned timestamp, so the event time is cast at the edge.
    """
    timed = events.withColumn("event_time", F.col("log_timestamp").cast("timestamp"))
    return timed.withWatermark("event_time", late_by).dropDuplicatesWithinWatermark(BUFFER_KEY)
