import json
from datetime import datetime

import pytest

from rows import job_message, messages
from runloom.sources.messages import parse_job_messages, parse_log_messages, rejected_rows, valid_rows

REFUSED = [
    ("missing_payload", None),
    ("missing_payload", ""),
    ("bad_json", '{"version":1,'),
    ("bad_json", "not json"),
    ("bad_version", job_message(version=2)),
    ("bad_version", job_message(version="1")),
    ("bad_version", job_message(version=...)),
    ("bad_event_id", job_message(eventId=5)),
    ("bad_worker_id", job_message(workerId=None)),
    ("bad_queue_name", job_message(queueName=...)),
    ("bad_queue_name", job_message(queueName=4)),
    ("bad_phase", job_message(phase="later")),
    ("bad_phase", job_message(phase=None)),
    ("bad_state", job_message(state="paused")),
    ("bad_state", job_message(state=None)),
    ("bad_tags", job_message(tags=None)),
    ("bad_tags", job_message(tags=["a", None])),
    ("bad_tags", job_message(tags=[None])),
    ("bad_tags", job_message(tags=["a", 1])),
    ("bad_tags", job_message(tags="a")),
    ("bad_job", job_message(job=...)),
    ("bad_job", job_message(job="x")),
    ("bad_job_id", job_message(job__id=...)),
    ("bad_job_id", job_message(job__id="")),
    ("bad_job_id", job_message(job__id=7)),
    ("bad_timestamp", job_message(job__timestamp=...)),
    ("bad_opts", job_message(job__opts=...)),
    ("bad_attempts_made", job_message(job__attemptsMade=40000)),
    ("bad_attempts_made", job_message(job__attemptsMade=None)),
    ("bad_max_attempts", job_message(job__opts__attempts=1.5)),
    ("bad_priority", job_message(job__opts__priority=3_000_000_000)),
    ("bad_delay", job_message(job__opts__delay=None)),
    ("bad_delay", job_message(job__opts__delay="5")),
    ("bad_parent", job_message(job__opts__parent={"id": 4})),
    ("bad_name", job_message(job__name=["n"])),
    ("bad_repeat_key", job_message(job__repeatJobKey=1)),
    ("bad_failed_reason", job_message(job__failedReason={"m": 1})),
    ("bad_stacktrace", job_message(job__stacktrace="at x")),
    ("bad_number", job_message(job__finishedOn="soon")),
    ("duration_overflow", job_message(job__processedOn=1, job__finishedOn=2_592_000_000)),
]


@pytest.fixture(scope="module")
def refused(spark):
    parsed = parse_job_messages(messages(spark, [p for _, p in REFUSED]))
    assert valid_rows(parsed).count() == 0
    return {r.seq: r.reject_reason for r in rejected_rows(parsed).collect()}


@pytest.mark.parametrize("seq", range(len(REFUSED)))
def test_refused(refused, seq):
    assert refused[seq] == REFUSED[seq][0]


ACCEPTED = [
    job_message(),
    job_message(version=1.0, workerId=..., phase=..., state=..., tags=..., job__attemptsMade=...,
                job__opts={}, job__data=..., job__name=...),
    job_message(tags=[], state="unknown", phase="terminal", job__processedOn=0, job__finishedOn=1704888001500,
                job__failedReason="boom", job__stacktrace=["a", None, "b"], job__returnvalue=None),
    job_message(state=..., phase="terminal", job__finishedOn=1704888001500, job__failedReason="",
                job__returnvalue={"z": 1, "a": [1.0]}, job__opts__priority=None, job__opts__parent=None,
                job__opts__backoff={"type": "fixed"}, job__repeatJobKey=None, job__attemptsMade=2.0),
]


@pytest.fixture(scope="module")
def accepted(spark):
    parsed = parse_job_messages(messages(spark, ACCEPTED))
    assert rejected_rows(parsed).count() == 0
    return {r.seq: r for r in valid_rows(parsed).collect()}


def test_plain_message(accepted):
    row = accepted[0]
    assert (row.queue, row.job_id, row.status, row.tags) == ("q", "7", "active", ["a"])
    assert (row.attempt, row.max_attempts, row.delay_ms, row.data) == (1, 2, 5, '{"a":2,"b":1}')
    assert row.created_at == row.enqueued_at == datetime(2024, 1, 10, 12)


def test_absent_fields_take_defaults(accepted):
    row = accepted[1]
    assert (row.attempt, row.max_attempts, row.delay_ms, row.tags, row.worker_id) == (0, 1, 0, [], None)
    assert (row.status, row.data, row.name) == ("active", None, None)


def test_falsy_times_and_failure(accepted):
    row = accepted[2]
    assert (row.status, row.error_message, row.error_stack) == ("failed", "boom", "a\n\nb")
    assert (row.started_at, row.finished_at) == (None, datetime(2024, 1, 10, 12, 0, 1, 500000))
    assert row.result is None


def test_empty_failure_text_means_completed(accepted):
    row = accepted[3]
    assert (row.status, row.result, row.backoff) == ("completed", '{"a":[1],"z":1}', '{"type":"fixed"}')
    assert row.attempt == 2


def _log(**changes):
    message = {"version": 1, "workerId": "w", "queueName": "q", "jobId": "7", "jobTimestamp": 1704888000000,
               "logTimestamp": 1704888000005, "logSeq": 2, "level": "warn", "message": "m"} | changes
    return json.dumps({k: v for k, v in message.items() if v is not ...})


def test_log_messages(spark):
    payloads = [_log(), _log(level="fatal"), _log(workerId=...), _log(logSeq=0.5), _log(jobTimestamp="1"), _log(message=5), "[]"]
    parsed = parse_log_messages(messages(spark, payloads))
    reasons = [r.reject_reason for r in parsed.orderBy("seq").collect()]
    assert reasons[:1] + reasons[1:6] == [None, "bad_level", "bad_worker_id", "bad_log_seq", "bad_job_timestamp", "bad_message"]
    assert reasons[6] in ("bad_json", "bad_version")
    row = valid_rows(parsed).first()
    assert (row.job_timestamp, row.log_seq, row.level) == (datetime(2024, 1, 10, 12), 2, "warn")


def test_the_payload_is_parsed_once(spark):
    plan = valid_rows(parse_job_messages(messages(spark, ACCEPTED)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
