"""Streaming windows: hourly statistics and the coalesced change feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators.rollup import measures, with_duration
from runloom.sources.tables import BATCH, write_batch


def hourly_stream(runs: DataFrame, late_by: str, as_of: datetime) -> DataFrame:
    """Hourly statistics of a stream of runs.

    The watermark bounds the state: hours older than ``late_by`` are closed, so
    it is set to the retention, beyond which late runs are dropped anyway.
    """
    timed = with_duration(runs).withColumn("event_time", F.col("created_at").cast("timestamp"))
    hours = timed.withWatermark("event_time", late_by).groupBy(F.window("event_time", "1 hour"), "queue")
    measured = hours.agg(*measures(as_of))
    return measured.withColumn("bucket_start", F.col("window.start").cast("timestamp_ntz")).drop("window")


def write_updates(stats: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the hours each trigger changed under the number of its batch."""
    writer = stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id))
    return (writer.trigger(availableNow=True) if once else writer).start()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key that the triggers wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in [*keys, BATCH]]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
    return last.select(*keys, "_row.*")


def current_hours(spark: SparkSession, path: str) -> DataFrame:
    return newest(spark, path, ["bucket_start", "queue"])


def coalesced(changes: DataFrame, second: str = "changed_at") -> DataFrame:
    """At most one message per second for each kind and id, the latest one.

    Works on frames and, in update or append mode, on streams with a watermark.
    """
    window = F.window(second, "1 second")
    rest = [c for c in changes.columns if c not in ("kind", "id", second)]
    latest = F.max_by(F.struct(*rest), F.struct(second, *rest)) if rest else F.max(second)
    grouped = changes.groupBy("kind", "id", window).agg(latest.alias("_row"), F.count(F.lit(1)).alias("merged"))
    fields = [F.col(f"_row.{c}").alias(c) for c in rest]
    return grouped.select("kind", "id", F.col("window.start").alias("second"), *fields, "merged")
