"""Hand-made rows for the tests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import types as T

from runloom import schemas

T0 = datetime(2024, 1, 10, 12)


def run(job_id="1", queue="q1", **values):
    row = {name: None for name in schemas.JOB_RUNS.names}
    row.update(
        id=f"{queue}/{job_id}", job_id=job_id, queue=queue, name="job", status="waiting", attempt=0, max_attempts=1,
        delay_ms=0, tags=[], created_at=T0, enqueued_at=T0,
    )
    row.update(values)
    if row["started_at"] and row["finished_at"] and row["duration_ms"] is None:
        row["duration_ms"] = int((row["finished_at"] - row["started_at"]) / timedelta(milliseconds=1))
    return row


def runs(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in schemas.JOB_RUNS.names) for r in rows], schemas.JOB_RUNS)


EVENTS = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("batch_id", T.LongType())]
    + [T.StructField(n, schemas.JOB_RUNS[n].dataType) for n in [*schemas.RUN_KEY, "status", "tags", *schemas.RUN_VALUES]]
)


def event(seq, status, batch_id=0, **values):
    row = run(status=status, **values)
    return tuple({**row, "seq": seq, "batch_id": batch_id}[n] for n in EVENTS.names)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def queues(spark, names, paused=()):
    rows = [(f"id-{n}", n, "{}", n in paused, T0) for n in names]
    return spark.createDataFrame(rows, schemas.QUEUES)


def schedulers(spark, rows):
    names = schemas.JOB_SCHEDULERS.names
    base = {n: None for n in names} | {"name": "s", "created_at": T0}
    return spark.createDataFrame(
        [tuple((base | {"id": f"id-{r['key']}"} | r)[n] for n in names) for r in rows], schemas.JOB_SCHEDULERS
    )


def job_message(**changes):
    """A valid job message; ``None`` in ``drop`` style paths is a JSON null."""
    message = {
        "version": 1, "workerId": "w", "queueName": "q", "phase": "active", "state": "active", "tags": ["a"],
        "job": {"id": "7", "name": "n", "timestamp": 1704888000000, "attemptsMade": 1, "opts": {"attempts": 2, "delay": 5},
                "data": {"b": 1, "a": 2}},
    }
    for path, value in changes.items():
        target = message
        *parents, last = path.split("__")
        for parent in parents:
            target = target.setdefault(parent, {})
        if value is ...:
            target.pop(last, None)
        else:
            target[last] = value
    return json.dumps(message)


def messages(spark, payloads):
    rows = list(enumerate(payloads))
    return spark.createDataFrame(rows, "seq long, payload string")
