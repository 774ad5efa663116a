"""Stored tables: reading, partitioned writing and replay-safe appends.

Tables are Parquet folders. Runs are partitioned by ``created_date``, logs by
``log_date`` and hourly statistics by ``bucket_date``; within a file rows are
sorted so that row-group statistics cut keyset and time predicates.

A table first written with ``versioned`` is replaced atomically from then on (see
:mod:`runloom.sources.versions`): every function here keeps to that, and a job
that dies at any point leaves the table as it was. Plain tables are overwritten
in place, as Spark does it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.functions.time import is_stored_instant, naive_utc, ts
from runloom.operators.upsert import BEFORE, OP, touched_dates, upsert_runs
from runloom.session import shared_dir
from runloom.sources.versions import Pointer, Versioned, is_versioned

BATCH = "batch_id"


def bloom(*columns: str) -> dict[str, str]:
    """Write options that give each row group a Bloom filter of the columns, as large as their values need."""
    options = {"parquet.bloom.filter.adaptive.enabled": "true"}
    for column in columns:
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.max.bytes#{column}"] = str(1 << 20)
    return options


# Columns that single rows are looked up by.
_RUNS_BLOOM, _LOGS_BLOOM = bloom("id", "job_id"), bloom("job_run_id")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return Versioned(spark, path).read() if is_versioned(spark, path) else spark.read.parquet(path)


def versioned_table(spark: SparkSession, path: str, partition: str, versioned: bool = False) -> Versioned | None:
    """The table at a path if it is, or is to be, a versioned one."""
    return Versioned(spark, path, partition) if versioned or is_versioned(spark, path) else None


def write_runs(runs: DataFrame, path: str, versioned: bool = False, seen: Pointer | None = None) -> None:
    """Write runs by creation date; dates that occur are replaced, others stay.

    Rows are rebalanced by date: AQE has a day of any size written by as many
    tasks as it takes, and quiet days by one together.
    """
    dated = runs.withColumn("created_date", F.to_date("created_at"))
    sort = ["created_at", "job_id"]
    if table := versioned_table(runs.sparkSession, path, "created_date", versioned):
        table.replace(dated, sort=sort, seen=seen, options=_RUNS_BLOOM)
    else:
        _write(_by(dated, "created_date").sortWithinPartitions("created_date", *sort), path, "created_date", _RUNS_BLOOM)


def upsert_table(path: str, incoming: DataFrame, images: bool = False, changes: str | None = None) -> DataFrame:
    """Upsert folded runs into a stored table and return what changed, with ``images`` also from what.

    Only the dates of the batch are read and rewritten; a first upsert creates
    the table. The new rows are written to a folder of their own first: the table
    is never read while it is being replaced, and an interrupted replacement can
    be repeated. That folder is removed at the end; the changes, which the result
    reads, stay, in ``changes`` for a caller who removes them after use.
    """
    spark = incoming.sparkSession
    staged, changes = shared_dir(spark, "upsert"), changes or shared_dir(spark, "changes")
    seen = _seen(spark, path)
    if seen or _folders(spark, path, "created_date"):
        rows = upsert_runs(touched_dates(_stored(spark, path, seen), incoming), incoming, images)
    else:
        rows = upsert_runs(incoming.limit(0), incoming, images)
    _replace(rows, path, staged, seen)
    read_table(spark, staged).filter(F.col(OP) != "keep").write.option("compression", "zstd").parquet(changes)
    delete(spark, staged)
    return read_table(spark, changes)


def apply_outcomes(path: str, outcomes: DataFrame) -> None:
    """Put the outcomes of commands and sweeps (id, status, error_message) on the stored runs.

    Ids occur once. Only the dates that hold one of the runs are rewritten. A
    null error leaves the stored one.
    """
    spark = outcomes.sparkSession
    staged = shared_dir(spark, "outcomes")
    seen = _seen(spark, path)
    stored = _stored(spark, path, seen)
    new = outcomes.select("id", F.col("status").alias("_status"), F.col("error_message").alias("_error"))
    # One row per date of the calendar at most.
    dates = stored.join(new, "id", "left_semi").filter(is_stored_instant(F.col("created_at"))).select("created_date").distinct()
    rows = stored.join(F.broadcast(dates), "created_date", "left_semi").join(new, "id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "error_message": F.coalesce("_error", "error_message"),
    })
    _replace(rows.select(*stored.columns), path, staged, seen)
    delete(spark, staged)


def _seen(spark: SparkSession, path: str) -> Pointer | None:
    """The version that work starts from; a table replaced meanwhile is not replaced again from old rows."""
    return Versioned(spark, path).current() if is_versioned(spark, path) else None


def _stored(spark: SparkSession, path: str, seen: Pointer | None) -> DataFrame:
    return Versioned(spark, path).read(at=seen) if seen else read_table(spark, path)


def _replace(rows: DataFrame, path: str, staged: str, seen: Pointer | None) -> None:
    spark = rows.sparkSession
    rows.write.option("compression", "zstd").parquet(staged)
    write_runs(spark.read.parquet(staged).drop(OP, BEFORE, "created_date"), path, seen=seen)


def delete_before(spark: SparkSession, path: str, partition: str, column: str, cut: datetime) -> None:
    """Delete what lies before an instant: whole folders of earlier dates, and rows of the date it falls on.

    Nothing of later dates is read.
    """
    day = naive_utc(cut).date()
    if table := versioned_table(spark, path, partition):
        seen = table.current()
        kept = table.read([str(day)], at=seen).filter(F.col(column) >= ts(cut))
        earlier = [v for v in seen.folders if v <= day.isoformat()]
        table.replace(kept, earlier, seen=seen, options=_RUNS_BLOOM if partition == "created_date" else None)
        return
    for folder in _folders(spark, path, partition):
        if folder < day.isoformat():
            delete(spark, f"{path.rstrip('/')}/{partition}={folder}")
    boundary = f"{path.rstrip('/')}/{partition}={day}"
    if exists(spark, boundary):
        staged = shared_dir(spark, "kept")
        read_table(spark, boundary).filter(F.col(column) >= ts(cut)).write.parquet(staged)
        read_table(spark, staged).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(boundary)
        delete(spark, staged)


def dates_of(spark: SparkSession, path: str, partition: str) -> list[str]:
    """The partition values of a table, from its list or its folders; no row is read."""
    if table := versioned_table(spark, path, partition):
        return table.values()
    return _folders(spark, path, partition)


def path_of(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = path_of(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    files, place = path_of(spark, path)
    files.delete(place, True)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files in a folder; none where there is no folder yet."""
    files, place = path_of(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(place)] if files.exists(place) else []
    return [name for name in names if not name.startswith(("_", "."))]


def _folders(spark: SparkSession, path: str, partition: str) -> list[str]:
    """Values of a table's partition column, by its folders; none where there is no table yet."""
    files, place = path_of(spark, path)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return [name.removeprefix(f"{partition}=") for name in names if name.startswith(f"{partition}=")]


def delete_runs_before(spark: SparkSession, runs: str, logs: str, cut: datetime) -> None:
    """Delete the runs created before an instant, and first the log lines of those runs.

    Of the runs only the dates up to the instant are read, of the logs only the
    dates that hold a line of such a run are rewritten. Both tables are
    versioned: each changes in one step, and a deletion that stopped in between
    is repeated as a whole.
    """
    day = naive_utc(cut).date()
    old = read_table(spark, runs).filter((F.col("created_date") <= F.lit(day)) & (F.col("created_at") < ts(cut)))
    doomed = old.select(F.col("id").alias("job_run_id"))
    lines = Versioned(spark, logs, "log_date")
    seen = lines.current()
    stored = lines.read(at=seen)
    # One row per date of the calendar at most.
    dates = [str(r["log_date"]) for r in stored.join(doomed, "job_run_id", "left_semi").select("log_date").distinct().collect()]
    if dates:
        kept = lines.read(dates, at=seen).join(doomed, "job_run_id", "left_anti").select(*seen.schema.names)
        lines.replace(kept, dates, ["job_run_id", "ts"], seen, _LOGS_BLOOM)
    delete_before(spark, runs, "created_date", "created_at", cut)


# Parts of the stored tag catalogue.
SHARDS = 16


def write_tags(tags: DataFrame, path: str) -> None:
    """Store a tag catalogue as a whole, as a versioned table."""
    sharded = tags.withColumn("shard", F.pmod(F.crc32("tag"), F.lit(SHARDS)).cast("int"))
    Versioned(tags.sparkSession, path, "shard").replace(sharded, [str(k) for k in range(SHARDS)], ["tag"])


def delete_tags_before(spark: SparkSession, path: str, cut: datetime) -> None:
    """Drop the tags last seen before an instant from a stored catalogue."""
    table = Versioned(spark, path, "shard")
    seen = table.current()
    table.replace(table.read(at=seen).filter(F.col("last_seen_at") >= ts(cut)), list(seen.folders), ["tag"], seen)


def write_logs(logs: DataFrame, path: str, versioned: bool = False) -> None:
    """Add log lines by date, each identity once.

    The dates of the lines are merged and replaced as a whole, so writing again
    after a failure leaves no second copy.
    """
    spark = logs.sparkSession
    dated = logs.withColumn("log_date", F.to_date("ts"))
    seen = _seen(spark, path)
    if seen or _folders(spark, path, "log_date"):
        # One row per date of the calendar at most.
        dates = dated.filter(is_stored_instant(F.col("ts"))).select("log_date").distinct()
        stored = _stored(spark, path, seen).join(F.broadcast(dates), "log_date", "left_semi")
        dated = stored.unionByName(dated.join(stored.select("id"), "id", "left_anti"))
    staged = shared_dir(spark, "logs")
    dated.write.parquet(staged)
    rows, sort = spark.read.parquet(staged), ["job_run_id", "ts"]
    if table := versioned_table(spark, path, "log_date", versioned):
        table.replace(rows, sort=sort, seen=seen, options=_LOGS_BLOOM)
    else:
        _write(_by(rows, "log_date").sortWithinPartitions("log_date", *sort), path, "log_date", _LOGS_BLOOM)
    delete(spark, staged)


def write_rollup(rollup: DataFrame, path: str, versioned: bool = False) -> None:
    """Write hourly statistics; dates that occur are replaced as a whole."""
    daily = rollup.withColumn("bucket_date", F.to_date("bucket_start"))
    sort = ["bucket_start", "queue"]
    if table := versioned_table(rollup.sparkSession, path, "bucket_date", versioned):
        table.replace(daily, sort=sort)
    else:
        _write(_by(daily, "bucket_date").sortWithinPartitions("bucket_date", *sort), path, "bucket_date")


def write_rollup_hour(rollup: DataFrame, path: str, bucket: datetime) -> None:
    """Replace one hour, also when it has become empty: its date is read and written again."""
    spark = rollup.sparkSession
    day = str(naive_utc(bucket).date())
    if table := versioned_table(spark, path, "bucket_date"):
        seen = table.current()
        rest = table.read([day], at=seen).filter(F.col("bucket_start") != ts(bucket))
        fresh = rollup.withColumn("bucket_date", F.to_date("bucket_start"))
        table.replace(rest.unionByName(fresh), [day], ["bucket_start", "queue"], seen)
        return
    folder = f"{path.rstrip('/')}/bucket_date={day}"
    staged = shared_dir(spark, "hour")
    rows = rollup
    if exists(spark, folder):
        rows = read_table(spark, folder).filter(F.col("bucket_start") != ts(bucket)).unionByName(rollup)
    rows.write.parquet(staged)
    final = read_table(spark, staged).sortWithinPartitions("bucket_start", "queue")
    final.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
    delete(spark, staged)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the outcome of one micro-batch under its number.

    A batch that is delivered again replaces its own folder, so replays after a
    failure leave no second copy.
    """
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
    writer.parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")


def _by(rows: DataFrame, partition: str) -> DataFrame:
    return rows.hint("rebalance", F.col(partition))


def _write(rows: DataFrame, path: str, partition: str, options: dict[str, str] | None = None) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**(options or {}))
    writer.partitionBy(partition).parquet(path)

