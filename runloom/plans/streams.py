"""Queries that run as streams over the ``events`` table until it is read through."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.plans import fixture as fx
from runloom.plans.checks import check
from runloom.plans.ingestion import (
    BUFFERED_CHECK, DRAINED_CHECK, FOLD_CHECK, LOST_CHECK, RESOLVED_CHECK, STATUS_CHECK, folded_columns,
)
from runloom.plans.registry import query
from runloom.session import FREED, SMALL_METHODS, configure, settings, shared_dir, spread
from runloom.sources.messages import parse_job_messages, parse_log_messages, valid_rows
from runloom.sources.streams import append_files, file_messages, table_stream
from runloom.sources.tables import read_table, write_batch
from runloom.streaming import ingest, resolve, state, windows


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    schema = configure(spark).read.parquet(f"{sf}/events.parquet").schema
    # Events are dealt out, not the messages made from them, which are many times as large.
    return fx.jobs_of(spread(table_stream(spark, sf, "events", schema), fx.tasks(spark, sf)))


@query(FOLD_CHECK)
def stream_fold(spark, sf):
    messages = fx.messages_of(_jobs(spark, sf)).drop("batch_id")
    path = shared_dir(spark, "fold")
    ingest.ingest_jobs(messages, path, f"{path}/checkpoint", fx.AS_OF).awaitTermination()
    return folded_columns(ingest.current_runs(spark, path))


def _in_four_files(messages: DataFrame, path: str, files: int) -> None:
    """Messages in their order of arrival, a file for each quarter, or as many as its size needs."""
    with settings(messages.sparkSession, FREED):
        for k in range(4):
            quarter = messages.filter(F.floor(F.col("batch_id") / 4) == k).select("seq", "payload")
            append_files(quarter, path, files)


@query(FOLD_CHECK)
def stream_fold_batches(spark, sf):
    """Micro-batches merged one by one into the stored runs table."""
    path = shared_dir(spark, "fold")
    files = fx.parts(spark, sf)
    _in_four_files(fx.job_messages(spark, sf), f"{path}/in", files)
    messages = file_messages(spark, f"{path}/in", format="parquet", max_files=files)
    ingest.ingest_jobs(
        messages, path, f"{path}/checkpoint", fx.AS_OF, table=f"{path}/runs", partitions=fx.tasks(spark, sf)).awaitTermination()
    return folded_columns(read_table(spark, f"{path}/runs"))


@query(FOLD_CHECK)
def stream_state_machine(spark, sf):
    """Four micro-batches through a state of its own for every run, merged into the stored table."""
    path = shared_dir(spark, "machine")
    files = fx.parts(spark, sf)
    _in_four_files(fx.job_messages(spark, sf), f"{path}/in", files)
    events = valid_rows(parse_job_messages(file_messages(spark, f"{path}/in", format="parquet", max_files=files)))
    state.read_through(state.ingest_states(events, f"{path}/runs", path, f"{path}/checkpoint", keep=timedelta(days=30)))
    return folded_columns(read_table(spark, f"{path}/runs"))


@query(STATUS_CHECK)
def stream_upsert_feed(spark, sf):
    """The last notice of every run that ingestion has changed, at most one a second each."""
    path = shared_dir(spark, "feed")
    files = fx.parts(spark, sf)
    _in_four_files(fx.job_messages(spark, sf), f"{path}/in", files)
    messages = file_messages(spark, f"{path}/in", format="parquet", max_files=files)
    ingest.ingest_jobs(
        messages, path, f"{path}/checkpoint", fx.AS_OF, table=f"{path}/runs", partitions=fx.tasks(spark, sf)).awaitTermination()
    state.read_through(state.upsert_feed(spark, path, f"{path}/feed", f"{path}/feed-checkpoint", max_files=8), quiet=4)
    return windows.newest(spark, f"{path}/feed", ["kind", "id"]).select("id", "status")


def _joined_logs(spark, sf) -> str:
    """Lines and runs as two streams of files, by the time of their jobs; half of the runs come a file late."""
    path, files = shared_dir(spark, "joined"), fx.parts(spark, sf)
    part = lambda moment: F.floor(F.dayofmonth(moment) / 8)
    # Parsed once for all files.
    parsed = valid_rows(parse_log_messages(fx.log_messages(spark, sf)))
    with settings(spark, {**FREED, **SMALL_METHODS}):
        parsed.withColumn("part", part("job_timestamp")).write.partitionBy("part").parquet(f"{path}/parsed")
    lines = spark.read.schema(parsed.withColumn("part", F.lit(0)).schema).parquet(f"{path}/parsed")
    runs = fx.job_runs(spark, sf).select("queue", "job_id", "enqueued_at", "id")
    late = F.pmod(F.crc32("job_id"), F.lit(2))
    with settings(spark, FREED):
        for k in range(5):
            append_files(lines.filter(F.col("part") == k).drop("part").repartition(files), f"{path}/lines", files)
            append_files(runs.filter(part("enqueued_at") + late == k).repartition(files), f"{path}/runs", files)
    # What comes last says how far time has got: nothing earlier is to be expected.
    end = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    lines = lines.drop("part")
    append_files(lines.limit(1).withColumns({"job_timestamp": end, "job_id": F.lit("end")}), f"{path}/lines", 1)
    append_files(runs.limit(1).withColumns({"enqueued_at": end, "job_id": F.lit("no line")}), f"{path}/runs", 1)

    def stream(name: str, like: DataFrame) -> DataFrame:
        return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/{name}")

    resolve.ingest_resolved(stream("lines", lines), stream("runs", runs), path, f"{path}/checkpoint", "17 days").awaitTermination()
    return path


@query(RESOLVED_CHECK)
def stream_logs_joined(spark, sf):
    """Lines that have met their run in a join of two streams, whichever came first."""
    return spark.read.parquet(f"{_joined_logs(spark, sf)}/logs").drop("batch_id")


@query(LOST_CHECK)
def stream_logs_expired(spark, sf):
    """Lines whose run never came, each once."""
    return spark.read.parquet(f"{_joined_logs(spark, sf)}/unresolved").drop("batch_id")


@query(DRAINED_CHECK)
def buffer_drained_empty(spark, sf):
    """A buffer whose lines all find their run at last: nothing waits, everything is stored."""
    path = shared_dir(spark, "logs")
    messages = fx.log_messages_of(_jobs(spark, sf)).drop("batch_id")
    runs = fx.job_runs(spark, sf)
    lost = runs.withColumn("job_id", F.concat(F.lit("lost-"), "job_id")).withColumn("id", F.concat(F.lit("lost-"), "id"))
    ingest.ingest_logs(messages, lambda: runs.limit(0), path, f"{path}/checkpoint", fx.AS_OF).awaitTermination()
    ingest.drain_buffer(spark, path, runs.union(lost))
    ingest.drain_buffer(spark, path, runs)
    waiting = ingest.current_buffer(spark, path).select(F.lit("waiting").alias("place"))
    stored = ingest.current_logs(spark, path).select(F.lit("stored").alias("place"))
    return waiting.union(stored).groupBy("place").agg(F.count(F.lit(1)).alias("lines"))


@query(RESOLVED_CHECK)
def drain_then_ingest(spark, sf):
    """Drains between runs of the ingestion, which goes on with the buffer as the drain has left it."""
    path = shared_dir(spark, "logs")
    messages, runs = fx.log_messages(spark, sf), fx.job_runs(spark, sf)
    files, tasks = fx.parts(spark, sf), fx.tasks(spark, sf)
    for k in range(2):
        half = messages.filter(F.floor(F.col("batch_id") / 8) == k).select("seq", "payload")
        append_files(half, f"{path}/in", 2 * files)
        source = file_messages(spark, f"{path}/in", format="parquet", max_files=files)
        known = runs.filter(F.crc32("job_id") % 2 == 0)
        ingest.ingest_logs(
            source, lambda known=known: known, path, f"{path}/checkpoint", fx.AS_OF, partitions=tasks).awaitTermination()
        ingest.drain_buffer(spark, path, runs)
    return ingest.current_logs(spark, path)


@query(RESOLVED_CHECK)
def stream_buffer_drained(spark, sf):
    """Lines that came before their runs, moved to the logs by a drain afterwards."""
    path = shared_dir(spark, "logs")
    files = fx.parts(spark, sf)
    _in_four_files(fx.log_messages(spark, sf), f"{path}/in", files)
    messages = file_messages(spark, f"{path}/in", format="parquet", max_files=files)
    runs = fx.job_runs(spark, sf)
    early = runs.filter(F.crc32("job_id") % 2 == 0)
    ingest.ingest_logs(
        messages, lambda: early, path, f"{path}/checkpoint", fx.AS_OF, partitions=fx.tasks(spark, sf)).awaitTermination()
    ingest.drain_buffer(spark, path, runs, 1_000_000)
    return ingest.current_logs(spark, path)


def _ingested_logs(spark, sf) -> str:
    messages = fx.log_messages_of(_jobs(spark, sf)).drop("batch_id")
    path = shared_dir(spark, "logs")
    ingest.ingest_logs(messages, lambda: fx.job_runs(spark, sf), path, f"{path}/checkpoint", fx.AS_OF).awaitTermination()
    return path


@query(RESOLVED_CHECK)
def stream_logs(spark, sf):
    return ingest.current_logs(spark, _ingested_logs(spark, sf))


@query(BUFFERED_CHECK)
def stream_log_buffer(spark, sf):
    return ingest.current_buffer(spark, _ingested_logs(spark, sf))


@query(check("SELECT * FROM rollup"))
def stream_hourly(spark, sf):
    runs = fx.runs_of(_jobs(spark, sf))
    path = shared_dir(spark, "hours")
    stats = windows.hourly_stream(runs, "30 days", fx.AS_OF)
    windows.write_updates(stats, f"{path}/hours", f"{path}/checkpoint").awaitTermination()
    return windows.current_hours(spark, f"{path}/hours")


@query(check("""
  SELECT 'queue' AS kind, queue AS id, date_trunc('second', created_at) AS second, COUNT(*) AS merged,
    arg_max(status, (created_at, status)) AS status
  FROM runs GROUP BY queue, date_trunc('second', created_at)"""))
def stream_change_feed(spark, sf):
    """At most one notice per queue and second, the latest."""
    changes = fx.runs_of(_jobs(spark, sf)).select(
        F.lit("queue").alias("kind"), F.col("queue").alias("id"), "status",
        F.col("created_at").cast("timestamp").alias("changed_at"),
    )
    path = shared_dir(spark, "feed")
    feed = windows.coalesced(changes.withWatermark("changed_at", "30 days"))
    windows.write_updates(feed, f"{path}/feed", f"{path}/checkpoint").awaitTermination()
    rows = windows.newest(spark, f"{path}/feed", ["kind", "id", "second"])
    return rows.withColumn("second", F.col("second").cast("timestamp_ntz"))


@query(check("""
  SELECT queue, job_id, job_timestamp, log_timestamp, log_seq FROM log_messages WHERE reject_reason IS NULL
  GROUP BY ALL"""))
def stream_distinct_lines(spark, sf):
    """Log lines of a stream, repeated deliveries dropped by identity."""
    lines = valid_rows(parse_log_messages(fx.log_messages_of(_jobs(spark, sf)).drop("batch_id")))
    path = shared_dir(spark, "lines")
    once = ingest.distinct_lines(lines, "30 days")
    writer = once.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda rows, batch_id: write_batch(rows, f"{path}/lines", batch_id)).start().awaitTermination()
    return spark.read.parquet(f"{path}/lines").select("queue", "job_id", "job_timestamp", "log_timestamp", "log_seq")
