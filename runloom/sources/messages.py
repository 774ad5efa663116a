"""Reading job and log messages: JSON text in, typed rows and rejects out.

A payload is read once, with VARIANT leaves, which keep the difference between
a missing, a null and a wrongly typed field that typed leaves would lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runloom.functions.status import derive_status
from runloom.functions.text import join_lines
from runloom.functions.time import from_any_epoch_ms, is_instant
from runloom.schemas import EVENT_PHASES, JOB_STATUSES, LOG_LEVELS, RUN_KEY, RUN_VALUES

REJECT = "reject_reason"
_DOC = "_doc"
_BAD = "_unreadable"
# JSON as producers write it, without the reader's usual lenience.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": _BAD}


def _leaves(kind: str, *names: str) -> str:
    return ", ".join(f"{n} {kind}" for n in names)


# Numbers that may be null are typed: the reader itself marks other types.
_OPTS_SCHEMA = _leaves("double", "priority") + ", " + _leaves("variant", "attempts", "delay", "backoff", "parent")
_BODY_SCHEMA = (
    _leaves("double", "timestamp", "processedOn", "finishedOn") + ", "
    + _leaves("variant", "id", "name", "attemptsMade", "failedReason", "stacktrace", "repeatJobKey", "data", "returnvalue")
    + f", opts struct<{_OPTS_SCHEMA}>"
)
_JOB_SCHEMA = (
    f"{_BAD} string, " + _leaves("variant", "version", "eventId", "workerId", "queueName", "phase", "state", "tags")
    + f", job struct<{_BODY_SCHEMA}>"
)
_LOG_SCHEMA = (
    f"{_BAD} string, " + _leaves("double", "jobTimestamp", "logTimestamp") + ", "
    + _leaves("variant", "version", "workerId", "queueName", "jobId", "logSeq", "level", "message")
)


def _leaf(path: str) -> Column:
    return F.col(f"{_DOC}.{path}")


def _kind(leaf: Column) -> Column:
    """Type name of a field: ``-`` where it is missing, VOID where it is null."""
    return F.coalesce(F.schema_of_variant(leaf), F.lit("-"))


def _get(leaf: Column, kind: str) -> Column:
    return F.try_variant_get(leaf, "$", kind)


def _text(path: str) -> Column:
    return _get(_leaf(path), "string")


def _number(path: str) -> Column:
    return _get(_leaf(path), "double")


def _instant(path: str) -> Column:
    return from_any_epoch_ms(_leaf(path))


def _is_instant(path: str, optional: bool = False) -> Column:
    """Whether a number of milliseconds is an instant; numbers of any size may arrive."""
    return F.coalesce(is_instant(_leaf(path)), F.lit(True) if optional else F.lit(False))


def _json(path: str) -> Column:
    """A nested value as canonical JSON text; a JSON null is no value."""
    return F.nullif(F.to_json(_leaf(path)), F.lit("null"))


def _is_text(leaf: Column, optional: bool = False, nullable: bool = False) -> Column:
    return _kind(leaf).isin(["STRING"] + ["-"] * optional + ["VOID"] * nullable)


def _one_of(path: str, values: list[str], optional: bool = False) -> Column:
    return _is_text(_leaf(path), optional) & F.coalesce(_text(path).isin(values), F.lit(True))


def _whole(number: Column, bits: int) -> Column:
    limit = 2 ** (bits - 1)
    return (number == F.floor(number)) & number.between(-limit, limit - 1)


def _is_integer(path: str, bits: int, optional: bool = False) -> Column:
    kind, limit = _kind(_leaf(path)), 2 ** (bits - 1)
    return (
        F.when(kind == "BIGINT", _get(_leaf(path), "bigint").between(-limit, limit - 1))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), _whole(_number(path), bits))
        .otherwise(kind == "-" if optional else F.lit(False))
    )


def _is_text_list(leaf: Column) -> Column:
    """A list of texts, or no list at all. An empty list has elements of no type."""
    items = _get(leaf, "array<string>")
    return (
        F.when(_kind(leaf) == "-", F.lit(True))
        .when(_kind(leaf) == "ARRAY<STRING>", ~F.exists(items, lambda x: x.isNull()))
        .otherwise((_kind(leaf) == "ARRAY<VOID>") & (F.size(items) == 0))
    )


def _is_list(leaf: Column) -> Column:
    return _kind(leaf).isin("-", "VOID") | _kind(leaf).startswith("ARRAY")


def _envelope(payload: str) -> list[tuple[str, Column]]:
    return [
        ("missing_payload", F.coalesce(F.col(payload) != "", F.lit(False))),
        ("bad_json", _leaf(_BAD).isNull() | _leaf("version").isNotNull()),
        ("bad_version", _is_integer("version", 32) & F.coalesce(_number("version") == 1, F.lit(False))),
    ]


def _job_checks(payload: str) -> list[tuple[str, Column]]:
    parent = F.try_variant_get(_leaf("job.opts.parent"), "$.id", "variant")
    return _envelope(payload) + [
        ("bad_event_id", _is_text(_leaf("eventId"), optional=True)),
        ("bad_worker_id", _is_text(_leaf("workerId"), optional=True)),
        ("bad_queue_name", _is_text(_leaf("queueName"))),
        ("bad_phase", _one_of("phase", EVENT_PHASES, optional=True)),
        ("bad_state", _one_of("state", JOB_STATUSES, optional=True)),
        ("bad_tags", _is_text_list(_leaf("tags"))),
        ("bad_job", _leaf("job").isNotNull()),
        ("bad_job_id", _is_text(_leaf("job.id")) & F.coalesce(_text("job.id") != "", F.lit(False))),
        ("bad_timestamp", _is_instant("job.timestamp")),
        ("bad_processed_on", _is_instant("job.processedOn", optional=True)),
        ("bad_finished_on", _is_instant("job.finishedOn", optional=True)),
        ("bad_opts", _leaf("job.opts").isNotNull()),
        ("bad_attempts_made", _is_integer("job.attemptsMade", 16, optional=True)),
        ("bad_max_attempts", _is_integer("job.opts.attempts", 16, optional=True)),
        ("bad_priority", F.coalesce(_whole(_leaf("job.opts.priority"), 32), F.lit(True))),
        ("bad_delay", _is_integer("job.opts.delay", 32, optional=True)),
        ("bad_parent", _is_text(parent, optional=True, nullable=True)),
        ("bad_name", _is_text(_leaf("job.name"), optional=True, nullable=True)),
        ("bad_repeat_key", _is_text(_leaf("job.repeatJobKey"), optional=True, nullable=True)),
        ("bad_failed_reason", _is_text(_leaf("job.failedReason"), optional=True, nullable=True)),
        ("bad_stacktrace", _is_list(_leaf("job.stacktrace"))),
        ("bad_number", _leaf(_BAD).isNull()),
        ("duration_overflow", _fits_int("job.processedOn", "job.finishedOn")),
    ]


def _moment(path: str) -> Column:
    return from_any_epoch_ms(F.nullif(_leaf(path), F.lit(0.0)))


def _fits_int(start: str, end: str) -> Column:
    """Whether the time between two instants fits an INT of milliseconds."""
    first, last = F.nullif(_leaf(start), F.lit(0.0)), F.nullif(_leaf(end), F.lit(0.0))
    return F.coalesce((last - first).between(-(2**31), 2**31 - 1), F.lit(True))


def _job_fields() -> dict[str, Column]:
    created = _instant("job.timestamp")
    number = lambda path, kind, default: F.coalesce(_number(path).try_cast(kind), F.lit(default).cast(kind))
    return {
        "queue": _text("queueName"),
        "job_id": _text("job.id"),
        "enqueued_at": created,
        "status": derive_status(
            _text("state"), _leaf("job.finishedOn"), _text("job.failedReason"),
            F.coalesce(_text("phase"), F.lit("snapshot")),
        ),
        "tags": F.coalesce(_get(_leaf("tags"), "array<string>"), F.array().cast("array<string>")),
        "name": _text("job.name"),
        "attempt": number("job.attemptsMade", "smallint", 0),
        "max_attempts": number("job.opts.attempts", "smallint", 1),
        "priority": _leaf("job.opts.priority").try_cast("int"),
        "delay_ms": number("job.opts.delay", "int", 0),
        "backoff": _json("job.opts.backoff"),
        "repeat_job_key": _text("job.repeatJobKey"),
        "parent_job_id": F.try_variant_get(_leaf("job.opts.parent"), "$.id", "string"),
        "worker_id": _text("workerId"),
        "data": _json("job.data"),
        "result": _json("job.returnvalue"),
        "error_message": _text("job.failedReason"),
        "error_stack": join_lines(_get(_leaf("job.stacktrace"), "array<string>")),
        "created_at": created,
        "started_at": _moment("job.processedOn"),
        "finished_at": _moment("job.finishedOn"),
    }


def _read(
    messages: DataFrame, payload: str, schema: str, checks: list[tuple[str, Column]], fields: dict[str, Column]
) -> DataFrame:
    kept = list(messages.columns)
    # The document comes out of a generator because filters on the reject reason
    # would otherwise be pushed below the parse and repeat it for every field.
    document = F.explode(F.array(F.from_json(payload, schema, _STRICT))).alias(_DOC)
    reason = F.coalesce(*[F.when(~ok, F.lit(reason)) for reason, ok in checks])
    rows = [column.alias(name) for name, column in fields.items()]
    return messages.select(*kept, document).select(*kept, reason.alias(REJECT), *rows)


def parse_job_messages(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Run rows of job messages, each with its reject reason (NULL when valid).

    The other columns of the messages (arrival order, batch) pass through, and
    so does the payload, which the rejects table keeps. The fields of refused
    messages mean nothing.
    """
    return _read(messages, payload, _JOB_SCHEMA, _job_checks(payload), _job_fields())


def parse_log_messages(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Log rows of log messages, each with its reject reason (NULL when valid)."""
    checks = _envelope(payload) + [
        ("bad_worker_id", _is_text(_leaf("workerId"))),
        ("bad_queue_name", _is_text(_leaf("queueName"))),
        ("bad_job_id", _is_text(_leaf("jobId"))),
        ("bad_job_timestamp", _is_instant("jobTimestamp")),
        ("bad_log_timestamp", _is_instant("logTimestamp")),
        ("bad_log_seq", _is_integer("logSeq", 32)),
        ("bad_level", _one_of("level", LOG_LEVELS)),
        ("bad_message", _is_text(_leaf("message"))),
    ]
    fields = {
        "queue": _text("queueName"),
        "job_id": _text("jobId"),
        "job_timestamp": _instant("jobTimestamp"),
        "log_timestamp": _instant("logTimestamp"),
        "log_seq": _number("logSeq").try_cast("int"),
        "level": _text("level"),
        "message": _text("message"),
    }
    return _read(messages, payload, _LOG_SCHEMA, checks, fields)


def valid_rows(parsed: DataFrame, payload: str = "payload") -> DataFrame:
    return parsed.filter(F.col(REJECT).isNull()).drop(REJECT, payload)


def rejected_rows(parsed: DataFrame, payload: str = "payload") -> DataFrame:
    """Messages that were refused, with the reason; kept, not dropped."""
    typed = [*RUN_KEY, "status", "tags", *RUN_VALUES, "job_timestamp", "log_timestamp", "log_seq", "level", "message"]
    return parsed.filter(F.col(REJECT).isNotNull()).drop(*typed)


def with_tags(jobs: DataFrame, tags: Column) -> DataFrame:
    """Tags computed by a caller's expression over the job columns, nulls dropped."""
    return jobs.withColumn("tags", F.filter(tags, lambda x: x.isNotNull()))
