"""Log lines: resolution against runs, the waiting buffer, reading and cleaning."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from runloom.functions.text import contains_ci, log_id, uuid_of
from runloom.functions.time import epoch_ms, millis_between, to_epoch_ms, ts
from runloom.operators.pruning import of_dates
from runloom.schemas import BUFFER_KEY, LOG_KEY, LOG_LEVELS

LOG_COLUMNS = ["id", "job_run_id", "level", "message", "ts", "log_seq"]
ORPHAN_AFTER = timedelta(hours=1)


def first_of_each(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The earliest row of each identity; later copies of it are ignored.

    An aggregate instead of a ranking window: copies are reduced before the
    shuffle, however many there are of one line.
    """
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def attach_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Log events with the id of their run, NULL while the run is unknown.

    Only the key and the id of the runs are read, of a table stored by date only
    the dates of the lines' jobs. The runs hold a key once, so the join never
    multiplies rows; partitions of a job with very many lines are split by AQE on
    the log side. Neither side is bounded, so both are sorted and merged: Spark
    would judge them by the bytes of their files, of which parsed lines are a
    multiple, and collect one on the driver.
    """
    known = of_dates(runs, events, "job_timestamp").select(
        "queue", "job_id", F.col("enqueued_at").alias("job_timestamp"), F.col("id").alias("job_run_id")
    )
    return events.join(known.hint("merge"), ["queue", "job_id", "job_timestamp"], "left")


def resolved(attached: DataFrame) -> DataFrame:
    """Lines that can be stored."""
    rows = attached.filter(F.col("job_run_id").isNotNull()).withColumn("ts", F.col("log_timestamp"))
    return rows.withColumn("id", log_id()).select(*LOG_COLUMNS)


def unresolved(attached: DataFrame, as_of: datetime) -> DataFrame:
    """Lines that wait in the buffer, stamped with the time they came in."""
    identity = [F.col("queue"), F.col("job_id"), to_epoch_ms(F.col("job_timestamp")).cast("string"),
                to_epoch_ms(F.col("log_timestamp")).cast("string"), F.col("log_seq").cast("string")]
    return attached.filter(F.col("job_run_id").isNull()).select(
        uuid_of(*identity).alias("id"), *BUFFER_KEY, "level", "message", ts(as_of).alias("created_at")
    )


def not_yet_stored(rows: DataFrame, stored: DataFrame, key: list[str] = LOG_KEY) -> DataFrame:
    """Rows whose identity the table does not hold yet; the table is never collected, as in :func:`attach_runs`."""
    return rows.join(stored.select(*key).hint("merge"), key, "left_anti")


def oldest(buffer: DataFrame, batch_size: int | None = 1000) -> DataFrame:
    """The part of the buffer one drain works on, the oldest lines first."""
    if batch_size is None:
        return buffer
    return buffer.orderBy("created_at", *BUFFER_KEY).limit(batch_size)


def drain(buffer: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """Every buffered line with its run, if known by now, and an orphan flag."""
    attached = attach_runs(buffer, runs)
    age = millis_between(F.col("created_at"), ts(as_of))
    orphan = F.col("job_run_id").isNull() & (age >= ORPHAN_AFTER // timedelta(milliseconds=1))
    return attached.withColumns({"age_ms": age, "is_orphan": orphan})


def still_buffered(buffer: DataFrame, drained: DataFrame) -> DataFrame:
    """The buffer without the lines a drain has stored, which may be any number."""
    done = drained.filter(F.col("job_run_id").isNotNull()).select("id")
    return buffer.join(done.hint("merge"), "id", "left_anti")


def backlog(drained: DataFrame, as_of: datetime) -> DataFrame:
    """Size and age of the buffer and the outcome of the drain, as one row."""
    first = F.min("created_at")
    return drained.agg(
        F.count(F.lit(1)).alias("backlog"),
        first.alias("oldest_created_at"),
        F.coalesce(F.lit(epoch_ms(as_of)) - to_epoch_ms(first), F.lit(0)).cast("long").alias("oldest_age_ms"),
        F.count("job_run_id").alias("resolved"),
        F.count_if(F.col("job_run_id").isNull()).alias("unresolved"),
    )


def filter_logs(
    logs: DataFrame, run_id: str | None = None, level: str | None = None, message_contains: str | None = None
) -> DataFrame:
    if level is not None and level not in LOG_LEVELS:
        raise ValueError(f"unknown log level: {level}")
    if run_id is not None:
        logs = logs.filter(F.col("job_run_id") == run_id)
    if level is not None:
        logs = logs.filter(F.col("level") == level)
    if message_contains:
        logs = logs.filter(contains_ci(F.col("message"), message_contains))
    return logs


def logs_page(logs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Lines in time order; ``position`` is the place in the full order."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must lie between 1 and 1000 and offset must not be negative")
    order = ["ts", "log_seq", "id"]
    page = logs.select(*LOG_COLUMNS).orderBy(*order).offset(offset).limit(limit)
    # At most `limit` rows are numbered here.
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy(*order)) + offset)
    return numbered.withColumn("ts", to_epoch_ms(F.col("ts")))


def line_counts(logs: DataFrame) -> DataFrame:
    """How many lines each run has in each hour: what deep offsets are looked up in.

    Kept beside a stored table and computed for the dates that are written; one
    row per run and hour with lines.
    """
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return logs.groupBy("job_run_id", F.to_date("ts").alias("log_date"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("lines"))


def stored_logs_page(logs: DataFrame, counts: DataFrame, run_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a run's lines in a table stored by date, as :func:`logs_page` gives it.

    The running sum of the run's hourly counts says in which hours the page
    lies; only their dates are opened, and of those the lines of the hours. So
    an offset of a million costs what the first page costs. The counts of one
    run are collected, one row per hour of its life.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must lie between 1 and 1000 and offset must not be negative")
    hours = counts.filter(F.col("job_run_id") == run_id).select("hour", "lines").orderBy("hour").collect()
    chosen, before, skipped = [], 0, 0
    for row in hours:
        if before + row["lines"] <= offset:
            skipped = before + row["lines"]
        elif before < offset + limit:
            chosen.append(row["hour"])
        before += row["lines"]
    rows = logs.filter(F.col("job_run_id") == run_id)
    if not chosen:
        return logs_page(rows.filter(F.lit(False)), limit)
    first, last = min(chosen), max(chosen)
    rows = rows.filter((F.col("ts") >= ts(first)) & (F.col("ts") < ts(last + timedelta(hours=1))))
    if "log_date" in logs.columns:
        rows = rows.filter(F.col("log_date").between(F.lit(first.date()), F.lit(last.date())))
    page = logs_page(rows, limit, offset - skipped)
    return page.withColumn("position", (F.col("position") + skipped).cast("int"))


def logs_total(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total"))


def drop_duplicates(logs: DataFrame) -> DataFrame:
    """Keep the line with the smallest id of each identity."""
    return first_of_each(logs, LOG_KEY, "id").select(*LOG_COLUMNS)


def number_lines(lines: DataFrame, order: str = "seq", block: int = 1_000_000) -> DataFrame:
    """Sequence number of each line within its job and millisecond, from zero.

    ``order`` is a unique arrival number. Lines are ranked inside blocks of
    arrival numbers, and blocks that continue a group start after the lines of
    the blocks before them. So no task ranks more than ``block`` lines of a
    group, whatever the group's size, and the numbers stay exact.
    """
    group = ["queue", "job_id", "log_timestamp"]
    blocked = lines.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    sizes = blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_block", F.sum("_size").over(before).alias("_start")).filter(F.col("_start") > 0)
    place = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(order)) - 1
    ranked = blocked.withColumn("_place", place).join(starts, [*group, "_block"], "left")
    number = (F.col("_place") + F.coalesce("_start", F.lit(0))).cast("int")
    return ranked.withColumn("log_seq", number).drop("_block", "_place", "_start")


def timeline(logs: DataFrame, runs: DataFrame, as_of: datetime) -> DataFrame:
    """Where each line lies between the due time and the end of its run, in percent."""
    due = to_epoch_ms(F.coalesce("enqueued_at", "created_at")) + F.col("delay_ms")
    spans = runs.select(
        F.col("id").alias("job_run_id"),
        F.greatest(to_epoch_ms(F.col("created_at")), due).alias("start_ms"),
        F.coalesce(to_epoch_ms(F.col("finished_at")), F.lit(epoch_ms(as_of))).alias("end_ms"),
    )
    total = F.col("end_ms") - F.col("start_ms")
    relative = to_epoch_ms(F.col("ts")) - F.col("start_ms")
    percent = F.when(total > 0, relative.cast("double") / total * 100).otherwise(F.lit(0.0))
    return logs.join(spans, "job_run_id").select(
        "id", "job_run_id", "level", "start_ms", "end_ms", relative.alias("relative_ms"), percent.alias("position_pct")
    )
