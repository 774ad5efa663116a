"""Hourly statistics kept by what changes.

Every changed run is taken out of the statistics as it was and put in as it is.
Counts and sums follow from that alone. A minimum or maximum does too, unless
the value taken out was the extreme itself and none as good was put in: only
those buckets are computed again from the stored runs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runloom.functions.status import is_terminal
from runloom.functions.time import duration_ms, is_stored_instant, trunc, ts, wait_ms
from runloom.operators.rollup import with_duration
from runloom.operators.upsert import BEFORE
from runloom.session import shared_dir
from runloom.sources.tables import delete
from runloom.sources.versions import Versioned

KEYS = ["bucket_start", "queue"]
COUNTS = ["total_runs", "completed_runs", "failed_runs", "active_runs", "waiting_runs", "duration_total_ms",
          "duration_count", "pressure_total_ms", "pressure_count"]
_EXTREMES = {"duration_min_ms": (F.min, F.least), "duration_max_ms": (F.max, F.greatest)}


def signed_images(changes: DataFrame) -> DataFrame:
    """The old image (sign -1) and the new one (+1) of each changed run.

    ``changes`` comes from an upsert with images. Images that the statistics
    cannot tell apart cancel out in the sums and are dropped here already.
    """
    fields = ["status", "created_at", "enqueued_at", "started_at", "finished_at"]

    def image(sign: int, column) -> Column:
        return F.struct(F.lit(sign).alias("sign"), *[column(f).alias(f) for f in fields])

    before = image(-1, lambda f: F.col("enqueued_at") if f == "enqueued_at" else F.col(f"{BEFORE}.{f}"))
    after = image(1, F.col)
    same = F.col(BEFORE).isNotNull()
    for f in fields:
        if f != "enqueued_at":
            same = same & F.col(f).eqNullSafe(F.col(f"{BEFORE}.{f}"))
    both = F.when(F.col(BEFORE).isNull(), F.array(after)).otherwise(F.array(before, after))
    return changes.filter(~same).select("queue", F.explode(both).alias("i")).select("queue", "i.*")


def rollup_deltas(images: DataFrame) -> DataFrame:
    """What the images add to each bucket, with the extremes that came and went; one shuffle of partial sums."""
    status, sign = F.col("status"), F.col("sign")
    images = images.withColumn("duration_ms", duration_ms())
    timed = F.when(status == "completed", F.col("duration_ms"))
    waited = F.when(is_terminal(status), wait_ms())

    def signed(value: Column) -> Column:
        return F.coalesce(F.sum(sign * value), F.lit(0)).cast("long")

    def counted(condition: Column) -> Column:
        return signed(F.when(condition, 1).otherwise(0))

    came, went = F.when(sign > 0, timed), F.when(sign < 0, timed)
    return images.groupBy(trunc("hour", F.col("created_at")).alias("bucket_start"), "queue").agg(
        signed(F.lit(1)).alias("total_runs"),
        *[counted(status == s).alias(f"{s}_runs") for s in ("completed", "failed", "active", "waiting")],
        signed(timed.cast("long")).alias("duration_total_ms"),
        counted(timed.isNotNull()).alias("duration_count"),
        signed(waited).alias("pressure_total_ms"),
        counted(waited.isNotNull()).alias("pressure_count"),
        *[f(came).alias(f"_came_{c}") for c, (f, _) in _EXTREMES.items()],
        *[f(went).alias(f"_went_{c}") for c, (f, _) in _EXTREMES.items()],
    )


def apply_deltas(stored: DataFrame, deltas: DataFrame, as_of: datetime) -> DataFrame:
    """The buckets that deltas touch, as they are now; ``_stale`` marks those whose extremes must be computed again.

    The deltas are those of one upsert, in which a run has one old and one new
    image. ``stored`` needs to hold the buckets of the deltas' dates only. A
    bucket without runs left has 0 in ``total_runs``.
    """
    old = stored.select(*KEYS, *[F.col(c).alias(f"_o_{c}") for c in [*COUNTS, *_EXTREMES]])
    both = deltas.join(old, KEYS, "left")
    counts = {c: F.col(c) + F.coalesce(F.col(f"_o_{c}"), F.lit(0)) for c in COUNTS}
    stale, extremes = F.lit(False), {}
    for c, (_, better) in _EXTREMES.items():
        held, came, went = F.col(f"_o_{c}"), F.col(f"_came_{c}"), F.col(f"_went_{c}")
        # The extreme went, and nothing as good came.
        stale = stale | (F.coalesce(went == held, F.lit(False)) & ~F.coalesce(better(held, came) == came, F.lit(False)))
        extremes[c] = better(held, came)
    some = counts["duration_count"] > 0
    return both.select(
        *KEYS, *[v.alias(c) for c, v in counts.items()], *[F.when(some, v).cast("int").alias(c) for c, v in extremes.items()],
        ts(as_of).alias("updated_at"), (some & stale).alias("_stale"))


def with_extremes(touched: DataFrame, runs: DataFrame) -> DataFrame:
    """Touched buckets with the extremes of stale ones taken from the runs.

    Only runs in the hours of stale buckets are read, from their dates if the
    table has them; where there are none, no run is.
    """
    stale = touched.filter("_stale").select(
        F.col("bucket_start").alias("_bucket"), F.col("queue").alias("_queue"), F.to_date("bucket_start").alias("_date"))
    hour = trunc("hour", F.col("created_at"))
    rows = with_duration(runs).filter((F.col("status") == "completed") & is_stored_instant(F.col("created_at")))
    on = (hour == F.col("_bucket")) & (F.col("queue") == F.col("_queue"))
    if "created_date" in runs.columns:
        on = on & (F.col("created_date") == F.col("_date"))
    rows = rows.join(stale, on, "left_semi")
    fresh = rows.groupBy(hour.alias("bucket_start"), "queue").agg(
        *[f("duration_ms").alias(f"_n_{c}") for c, (f, _) in _EXTREMES.items()])
    joined = touched.join(fresh, KEYS, "left")
    return joined.select(
        *[F.when(F.col("_stale"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in _EXTREMES else F.col(c)
          for c in touched.columns if c != "_stale"])


def maintain(spark: SparkSession, path: str, changes: DataFrame, runs: DataFrame, as_of: datetime) -> None:
    """Bring a stored, versioned table of hourly statistics up to date after an upsert.

    ``changes`` are the upsert's, with images, and ``runs`` the table after it.
    The statistics of the dates that changed are read and replaced in one step;
    buckets that have lost all runs go.
    """
    table = Versioned(spark, path, "bucket_date")
    seen = table.current()
    deltas = rollup_deltas(signed_images(changes)).withColumn("bucket_date", F.to_date("bucket_start"))
    staged = shared_dir(spark, "deltas")
    deltas.write.parquet(staged)
    deltas = spark.read.parquet(staged)
    # One row per date of the calendar at most.
    dates = [str(r["bucket_date"]) for r in deltas.select("bucket_date").distinct().collect()]
    if not dates:
        return
    stored = table.read(dates, at=seen)
    touched = with_extremes(apply_deltas(stored, deltas, as_of), runs).filter("total_runs > 0")
    rest = stored.join(deltas, KEYS, "left_anti")
    rows = rest.unionByName(touched.withColumn("bucket_date", F.to_date("bucket_start")))
    table.replace(rows, dates, ["bucket_start", "queue"], seen)
    delete(spark, staged)
