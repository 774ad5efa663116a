"""Table, stream and snapshot schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the two enumerated columns and the groups of
# statuses the operators distinguish.
JOB_STATUSES = ["active", "completed", "failed", "waiting", "delayed", "prioritized", "waiting-children", "unknown"]
LOG_LEVELS = ["log", "debug", "info", "warn", "error"]
EVENT_PHASES = ["waiting", "active", "terminal", "snapshot"]
TERMINAL_STATUSES = ["completed", "failed"]
NON_TERMINAL_STATUSES = ["waiting", "active", "delayed", "prioritized", "waiting-children", "unknown"]


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_text, _int, _short, _long = T.StringType(), T.IntegerType(), T.ShortType(), T.LongType()
_ts, _bool, _tags = T.TimestampNTZType(), T.BooleanType(), T.ArrayType(T.StringType())

JOB_RUNS = _schema(
    ("id", _text, False),
    ("job_id", _text, False),
    ("queue", _text, False),
    ("name", _text, True),
    ("status", _text, False),
    ("attempt", _short, False),
    ("max_attempts", _short, False),
    ("priority", _int, True),
    ("delay_ms", _int, False),
    ("backoff", _text, True),
    ("repeat_job_key", _text, True),
    ("parent_job_id", _text, True),
    ("worker_id", _text, True),
    ("tags", _tags, True),
    ("data", _text, True),
    ("result", _text, True),
    ("error_message", _text, True),
    ("error_stack", _text, True),
    ("created_at", _ts, False),
    ("enqueued_at", _ts, True),
    ("started_at", _ts, True),
    ("finished_at", _ts, True),
    ("duration_ms", _int, True),
)

JOB_LOGS = _schema(
    ("id", _text, False),
    ("job_run_id", _text, False),
    ("level", _text, False),
    ("message", _text, False),
    ("ts", _ts, False),
    ("log_seq", _int, False),
)

JOB_LOG_BUFFER = _schema(
    ("id", _text, False),
    ("queue", _text, False),
    ("job_id", _text, False),
    ("job_timestamp", _ts, False),
    ("log_timestamp", _ts, False),
    ("log_seq", _int, False),
    ("level", _text, False),
    ("message", _text, False),
    ("created_at", _ts, False),
)

QUEUES = _schema(
    ("id", _text, False),
    ("name", _text, False),
    ("default_job_options", _text, True),
    ("is_paused", _bool, False),
    ("created_at", _ts, False),
)

JOB_SCHEDULERS = _schema(
    ("id", _text, False),
    ("queue_id", _text, False),
    ("key", _text, False),
    ("name", _text, False),
    ("limit", _int, True),
    ("end_date", _ts, True),
    ("tz", _text, True),
    ("pattern", _text, True),
    ("every", _int, True),
    ("template", _text, True),
    ("created_at", _ts, False),
)

QUEUE_HOURLY_STATS = _schema(
    ("bucket_start", _ts, False),
    ("queue", _text, False),
    ("total_runs", _long, False),
    ("completed_runs", _long, False),
    ("failed_runs", _long, False),
    ("active_runs", _long, False),
    ("waiting_runs", _long, False),
    ("duration_total_ms", _long, False),
    ("duration_count", _long, False),
    ("duration_min_ms", _int, True),
    ("duration_max_ms", _int, True),
    ("pressure_total_ms", _long, False),
    ("pressure_count", _long, False),
    ("updated_at", _ts, False),
)

JOB_TAGS = _schema(
    ("tag", _text, False),
    ("tag_lower", _text, False),
    ("last_seen_at", _ts, False),
    ("updated_at", _ts, False),
)

# A row is identified by this key everywhere; `id` is derived from it.
RUN_KEY = ["queue", "job_id", "enqueued_at"]
LOG_KEY = ["job_run_id", "ts", "log_seq"]
BUFFER_KEY = ["queue", "job_id", "job_timestamp", "log_timestamp", "log_seq"]

# Columns of a run that the upsert takes over from an event, apart from the
# key, the status and the tags, which have rules of their own.
RUN_VALUES = [
    "name", "attempt", "max_attempts", "priority", "delay_ms", "backoff", "repeat_job_key",
    "parent_job_id", "worker_id", "data", "result", "error_message", "error_stack",
    "created_at", "started_at", "finished_at",
]

# Columns of the job list: payload columns stay unread in the scan.
RUN_LIST_COLUMNS = [
    "id", "job_id", "queue", "name", "status", "attempt", "max_attempts", "created_at",
    "enqueued_at", "started_at", "finished_at", "duration_ms", "error_message", "tags",
]
