"""Bringing stored tables in line with snapshots of the live queues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from runloom.functions.status import derive_status, is_open
from runloom.functions.text import canonical_json, discovered_queue, drop_null, uuid_of
from runloom.functions.time import DAY, naive_utc, ts
from runloom.operators.upsert import upsert_changes

STALLED_AFTER = DAY
SCHEDULER_FIELDS = ["queue_id", "name", "limit", "end_date", "tz", "pattern", "every", "template"]
QUEUE_FIELDS = ["default_job_options", "is_paused"]
_JSON_FIELDS = {"template", "default_job_options"}


def discover_queues(keys: DataFrame, column: str = "key") -> DataFrame:
    """Distinct queue names in a list of broker keys."""
    return keys.select(discovered_queue(F.col(column)).alias("name")).filter(F.col("name").isNotNull()).distinct()


def missing(stored: DataFrame, snapshot: DataFrame, on: list[str]) -> DataFrame:
    """Stored rows that a snapshot no longer has."""
    return stored.join(snapshot.select(*on), on, "left_anti")


def _comparable(name: str, prefix: str) -> Column:
    column = F.col(f"{prefix}{name}")
    return canonical_json(column) if name in _JSON_FIELDS else column


def _diff(stored: DataFrame, snapshot: DataFrame, key: str, fields: list[str], may_delete: Column) -> DataFrame:
    """Outer join of both sides by key with the fields that changed.

    Keys are unique on both sides. ``may_delete`` is judged on the stored row.
    The result carries the new value of every field (the stored one for rows
    that go) and ``_op``.
    """
    old = stored.select(
        key, "id", "created_at", may_delete.alias("_may_delete"), *[F.col(f).alias(f"_o_{f}") for f in fields]
    )
    new = snapshot.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_seen"))
    both = old.join(new, key, "full_outer")
    changed = drop_null(F.array(*[
        F.when(~_comparable(f, "_n_").eqNullSafe(_comparable(f, "_o_")), F.lit(f)) for f in fields
    ]))
    seen, known = F.col("_seen").isNotNull(), F.col("id").isNotNull()
    op = (
        F.when(~seen, F.when(F.col("_may_delete"), F.lit("delete")).otherwise(F.lit("keep")))
        .when(~known, F.lit("insert"))
        .when(F.size(changed) > 0, F.lit("update"))
        .otherwise(F.lit("keep"))
    )
    values = [F.when(seen, F.col(f"_n_{f}")).otherwise(F.col(f"_o_{f}")).alias(f) for f in fields]
    return both.select(
        "id", key, *values, "created_at", op.alias("_op"),
        F.when(op == "update", changed).otherwise(F.array().cast("array<string>")).alias("changed_keys"),
    )


def diff_queues(stored: DataFrame, snapshot: DataFrame, complete: bool) -> DataFrame:
    """What a queue scan does to the queue table.

    ``complete`` says whether the scan saw every key. An incomplete scan deletes
    nothing; a complete one that found no queue deletes all.
    """
    return _diff(stored, snapshot, "name", QUEUE_FIELDS, F.lit(complete))


def apply_queue_diff(diff: DataFrame, as_of: datetime) -> DataFrame:
    """The queue table after the scan."""
    kept = diff.filter(F.col("_op") != "delete")
    return kept.select(
        F.coalesce("id", uuid_of(F.col("name"))).alias("id"), "name", *QUEUE_FIELDS,
        F.coalesce("created_at", ts(as_of)).alias("created_at"),
    )


def diff_schedulers(stored: DataFrame, snapshot: DataFrame, queues: DataFrame) -> DataFrame:
    """What the scheduler lists of the scanned ``queues`` do to the scheduler table.

    The snapshot names queues; schedulers of queues that were not scanned stay.
    """
    ids = queues.select(F.col("id").alias("queue_id"), F.col("name").alias("queue"))
    listed = snapshot.join(ids, "queue").drop("queue")
    flagged = stored.join(ids.select("queue_id", F.lit(True).alias("_scanned")), "queue_id", "left")
    return _diff(flagged, listed, "key", SCHEDULER_FIELDS, F.col("_scanned").isNotNull())


def live_runs(live: DataFrame) -> DataFrame:
    """Rows of a live job snapshot as the upsert takes them.

    The broker state decides the status where it says something, the finish time
    and failure text otherwise. A snapshot carries no tags.
    """
    finished = F.when(F.col("finished_at").isNotNull(), F.lit(1))
    status = derive_status(F.col("state"), finished, F.col("error_message"), F.lit("snapshot"))
    return live.withColumns({"status": status, "tags": F.array().cast("array<string>")}).drop("state")


def reconcile_live(runs: DataFrame, live: DataFrame) -> DataFrame:
    """Changes that a snapshot of live jobs makes to the runs."""
    return upsert_changes(runs, live_runs(live))


def _of_scanned(runs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Runs of the queues (column ``name``) whose jobs were read; a failed read says nothing about the others."""
    return runs.join(scanned.select(F.col("name").alias("queue")), "queue", "left_semi")


def reconcile_missing(runs: DataFrame, live: DataFrame, scanned: DataFrame) -> DataFrame:
    """Unfinished runs of ``scanned`` queues that no live job stands for: their status is not known.

    All of them are handled in one pass.
    """
    runs = _of_scanned(runs, scanned)
    known = live.select("queue", "job_id").distinct()
    lost = runs.filter(is_open(F.col("status"))).join(known, ["queue", "job_id"], "left_anti")
    return lost.select("id", "queue", "job_id", F.col("status").alias("old_status"), F.lit("unknown").alias("status"))


def stalled(runs: DataFrame, live: DataFrame, as_of: datetime, scanned: DataFrame) -> DataFrame:
    """Runs of ``scanned`` queues active or waiting for a day: failed when gone, re-read when their state moved on."""
    runs = _of_scanned(runs, scanned)
    cut = naive_utc(as_of) - STALLED_AFTER
    old = runs.filter(F.col("status").isin("active", "waiting") & (F.col("created_at") <= ts(cut)))
    if "created_date" in runs.columns:
        old = old.filter(F.col("created_date") <= F.lit(cut.date()))
    states = live.groupBy("queue", "job_id").agg(F.max("state").alias("live_state"))
    both = old.select("id", "queue", "job_id", "status").join(states, ["queue", "job_id"], "left")
    gone = F.col("live_state").isNull()
    return both.filter(gone | (F.col("live_state") != F.col("status"))).select(
        "id", "queue", "job_id", F.col("status").alias("old_status"), "live_state",
        F.when(gone, F.lit("fail")).otherwise(F.lit("resend")).alias("action"),
        F.when(gone, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.when(gone, F.lit("Job stalled")).alias("error_message"),
    )
