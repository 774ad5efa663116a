"""Log resolution as a join of two streams.

Lines and runs come in any order. Both sides carry a watermark on the creation
time of the job, which is part of the join key: a line waits in the state of the
join until its run comes, and when the watermark has passed its job it leaves as
unresolved, once. So there is no buffer to drain, and what waits is bounded by
``late_by``. It waits in RocksDB, on the executors' disks and in the checkpoint,
not in their heaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators.logs import resolved
from runloom.schemas import BUFFER_KEY
from runloom.sources.tables import write_batch
from runloom.streaming.state import rocksdb

# The two sides of the join share one store instead of two each.
_JOIN = {"spark.sql.streaming.join.stateFormatVersion": "3"}


def resolve_stream(lines: DataFrame, runs: DataFrame, late_by: str) -> DataFrame:
    """A stream of parsed lines with the id of their run, or without one when none came in time.

    ``runs`` is a stream of job events or runs, of which key and id are looked
    at. Copies of a line and of a run are dropped by identity, so a line comes
    out once.
    """
    timed = lines.withColumn("_line_time", F.col("job_timestamp").cast("timestamp"))
    timed = timed.withWatermark("_line_time", late_by).dropDuplicatesWithinWatermark(BUFFER_KEY)
    known = runs.select(
        F.col("queue").alias("_queue"), F.col("job_id").alias("_job_id"), F.col("id").alias("job_run_id"),
        F.col("enqueued_at").cast("timestamp").alias("_run_time"))
    known = known.withWatermark("_run_time", late_by).dropDuplicatesWithinWatermark(["_queue", "_job_id", "_run_time"])
    same = (F.col("queue") == F.col("_queue")) & (F.col("job_id") == F.col("_job_id")) & (F.col("_line_time") == F.col("_run_time"))
    return timed.join(known, same, "left_outer").drop("_queue", "_job_id", "_run_time", "_line_time")


def ingest_resolved(lines: DataFrame, runs: DataFrame, path: str, checkpoint: str, late_by: str, once: bool = True) -> StreamingQuery:
    """Lines with their run go to ``path/logs``, those that have waited in vain to ``path/unresolved``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            write_batch(resolved(rows), f"{path}/logs", batch_id)
            lost = rows.filter(F.col("job_run_id").isNull()).select(*BUFFER_KEY, "level", "message")
            write_batch(lost, f"{path}/unresolved", batch_id)
        finally:
            rows.unpersist()

    with rocksdb(lines.sparkSession, _JOIN):
        writer = resolve_stream(lines, runs, late_by).writeStream.foreachBatch(handle).outputMode("append").option(
            "checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
