"""Queries over parsed messages, folds, upserts and log resolution."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from runloom.functions.status import derive_status, is_terminal, normalise_state
from runloom.operators import deltas, logs as lg, upsert as up
from runloom.operators.rollup import hourly_rollup
from runloom.plans import fixture as fx
from runloom.plans.checks import AS_OF, check, uuid_sql
from runloom.plans.registry import query
from runloom.session import shared_dir
from runloom.sources import tables
from runloom.sources.versions import Versioned
from runloom.sources.messages import parse_job_messages, parse_log_messages, rejected_rows, valid_rows, with_tags

_VALID = "SELECT * FROM messages WHERE reject_reason IS NULL"
_EVENT = """queue, job_id, created_at AS enqueued_at, name, attempt, max_attempts, priority, delay_ms, backoff,
    repeat_job_key, parent_job_id, worker_id, data, created_at"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", F.array_join("tags", ","))


def _events(spark, sf) -> DataFrame:
    return valid_rows(parse_job_messages(fx.job_messages(spark, sf)))


@query(check(f"""
  SELECT seq, batch_id, {_EVENT}, event_status AS status, array_to_string(event_tags, ',') AS tags,
    event_result AS result, event_error AS error_message,
    event_error || chr(10) || '    at work' AS error_stack, event_started AS started_at, event_finished AS finished_at
  FROM valid""", valid=_VALID))
def parse_job_events(spark, sf):
    return _flat(_events(spark, sf))


@query(check("""
  SELECT reject_reason, COUNT(*) AS rejected, CAST(SUM(seq % 1000003) AS BIGINT) AS seq_sum, COUNT(DISTINCT batch_id) AS batches
  FROM messages WHERE reject_reason IS NOT NULL GROUP BY 1"""))
def job_event_rejects(spark, sf):
    rejects = rejected_rows(parse_job_messages(fx.job_messages(spark, sf)))
    return rejects.groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("rejected"), F.sum(F.col("seq") % 1000003).alias("seq_sum"), F.count_distinct("batch_id").alias("batches")
    )


@query(check("""
  SELECT seq, batch_id, queue, job_id, job_timestamp, log_timestamp, log_seq, level, message
  FROM log_messages WHERE reject_reason IS NULL"""))
def parse_log_events(spark, sf):
    return valid_rows(parse_log_messages(fx.log_messages(spark, sf)))


@query(check("SELECT seq, batch_id, reject_reason FROM log_messages WHERE reject_reason IS NOT NULL"))
def log_event_rejects(spark, sf):
    return rejected_rows(parse_log_messages(fx.log_messages(spark, sf))).drop("payload")


@query(check("""
  SELECT queue, job_id, CASE WHEN priority IS NULL THEN name ELSE name || ',p' || priority END AS tags FROM runs"""))
def tags_callback(spark, sf):
    """Tags computed by an expression of the caller; undefined ones fall away."""
    urgent = F.concat(F.lit("p"), F.col("priority").cast("string"))
    tagged = with_tags(fx.job_runs(spark, sf), F.array(F.col("name"), urgent))
    return _flat(tagged.select("queue", "job_id", "tags"))


_STATES = "['completed', 'failed', 'active', 'waiting', 'delayed', 'prioritized', 'waiting-children', 'wait', 'paused', 'unknown', 'other', NULL]"


@query(check(f"""
  SELECT event_id, state, normalised, status, status IN ('completed', 'failed') AS terminal FROM (
    SELECT *, CASE WHEN normalised IS NOT NULL THEN normalised
        WHEN finished <> 0 AND error_message <> '' THEN 'failed' WHEN finished <> 0 THEN 'completed'
        WHEN event_id % 2 = 0 THEN 'waiting' ELSE 'active' END AS status
    FROM (SELECT event_id, state, error_message,
            CASE WHEN ends IS NULL AND event_id % 3 = 0 THEN 0 ELSE ends END AS finished,
            CASE WHEN state IN ('wait', 'paused') THEN 'waiting' WHEN state IN ('unknown', 'other') THEN NULL
              ELSE state END AS normalised
          FROM (SELECT *, {_STATES}[CAST(event_id % 12 AS INTEGER) + 1] AS state FROM jobs)))"""))
def status_rules(spark, sf):
    """Status of every job under every broker state."""
    states = "array" + _STATES.replace("[", "(").replace("]", ")")
    jobs = fx.jobs(spark, sf).select(
        "event_id", "error_message",
        F.element_at(F.expr(states), (F.col("event_id") % 12 + 1).cast("int")).alias("state"),
        F.expr("case when _end is null and event_id % 3 = 0 then 0 else _end end").alias("finished"),
        F.expr("case when event_id % 2 = 0 then 'waiting' else 'active' end").alias("phase"),
    )
    status = derive_status(F.col("state"), F.col("finished"), F.col("error_message"), F.col("phase"))
    rows = jobs.select("event_id", "state", normalise_state(F.col("state")).alias("normalised"), status.alias("status"))
    return rows.withColumn("terminal", is_terminal(F.col("status")))


# Folds.

_ROW_STRUCT = "{'status': event_status, 'started': event_started, 'finished': event_finished, 'error': event_error, 'result': event_result, 'row': event_id}"


def _fold_sql(source: str) -> str:
    """Fold of a set of events by aggregates over the arrival order."""
    return f"""
      SELECT queue, job_id, created_at AS enqueued_at, created_ms,
        COALESCE(arg_max(event_status, seq) FILTER (WHERE event_status IN ('completed', 'failed')),
          arg_max(event_status, seq)) AS status,
        COALESCE(array_to_string(arg_max(event_tags, seq) FILTER (WHERE len(event_tags) > 0), ','), '') AS tags,
        arg_max({_ROW_STRUCT}, seq).started AS started_at, arg_max({_ROW_STRUCT}, seq).finished AS finished_at,
        arg_max({_ROW_STRUCT}, seq).error AS error_message, arg_max({_ROW_STRUCT}, seq).result AS result
      FROM {source} GROUP BY 1, 2, 3, 4"""


_ID = uuid_sql("queue", "job_id", "CAST(created_ms AS VARCHAR)")
_FOLDED = f"""SELECT {_ID} AS id, queue, job_id, enqueued_at, status, tags, started_at, finished_at, error_message, result,
    CAST(date_diff('millisecond', started_at, finished_at) AS INTEGER) AS duration_ms FROM folded"""
FOLD_CHECK = check(_FOLDED, valid=_VALID, folded=_fold_sql("valid"))
STATUS_CHECK = check(f"SELECT {_ID} AS id, status FROM folded", valid=_VALID, folded=_fold_sql("valid"))
_FOLD_COLUMNS = ["id", "queue", "job_id", "enqueued_at", "status", "tags", "started_at", "finished_at",
                 "error_message", "result", "duration_ms"]


def folded_columns(runs: DataFrame) -> DataFrame:
    return _flat(runs.select(*_FOLD_COLUMNS))


@query(FOLD_CHECK)
def fold_per_event(spark, sf):
    return folded_columns(up.fold(_events(spark, sf)))


@query(check(
    _FOLDED, valid=_VALID,
    survivors="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queue, job_id, created_at, batch_id
                   ORDER BY seq DESC) AS n FROM valid) WHERE n = 1""",
    folded=_fold_sql("survivors"),
))
def fold_last_in_batch(spark, sf):
    return folded_columns(up.fold(_events(spark, sf), semantics="last_in_batch"))


@query(FOLD_CHECK)
def fold_merged_batches(spark, sf):
    """States of single batches merge to the fold of all events."""
    events = _events(spark, sf)
    odd, even = F.col("batch_id") % 2 == 1, F.col("batch_id") % 2 == 0
    states = up.fold_states(events.filter(odd)).unionByName(up.fold_states(events.filter(even)))
    return folded_columns(up.runs_of_states(up.merge_states(states)))


_UPSERT = {
    "valid": _VALID,
    "stored_events": "SELECT * FROM valid WHERE batch_id < 8",
    "fresh_events": "SELECT * FROM valid WHERE batch_id >= 8",
    "stored": _fold_sql("stored_events"),
    "fresh": _fold_sql("fresh_events"),
    "folded": _fold_sql("valid"),
    "after": """
      SELECT f.*, CASE WHEN s.job_id IS NULL THEN 'insert' WHEN n.job_id IS NULL THEN 'keep'
          WHEN s.status IS NOT DISTINCT FROM f.status AND s.tags IS NOT DISTINCT FROM f.tags
            AND s.started_at IS NOT DISTINCT FROM f.started_at AND s.finished_at IS NOT DISTINCT FROM f.finished_at
            AND s.error_message IS NOT DISTINCT FROM f.error_message AND s.result IS NOT DISTINCT FROM f.result THEN 'keep'
          ELSE 'update' END AS op
      FROM folded f LEFT JOIN stored s USING (queue, job_id, enqueued_at)
        LEFT JOIN fresh n USING (queue, job_id, enqueued_at)""",
}


def _two_halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    events = _events(spark, sf)
    return up.fold(events.filter("batch_id < 8")), up.fold(events.filter("batch_id >= 8"))


@query(check(f"SELECT op, * FROM ({_FOLDED.replace('FROM folded', ', op FROM after')})".replace("SELECT op, *", "SELECT *"),
             **_UPSERT))
def upsert_job_runs(spark, sf):
    after = up.upsert_runs(*_two_halves(spark, sf))
    return _flat(after.select(*_FOLD_COLUMNS, F.col(up.OP).alias("op")))


@query(FOLD_CHECK)
def upsert_stored_table(spark, sf):
    """Both halves upserted into a stored table, the first of which creates it."""
    path = shared_dir(spark, "runs")
    for half in _two_halves(spark, sf):
        tables.upsert_table(path, half)
    return folded_columns(tables.read_table(spark, path))


_FINISHED = "status IN ('completed', 'failed') AND started_at IS NOT NULL"


@query(check(f"""
  SELECT date_trunc('hour', enqueued_at) AS bucket_start, queue, COUNT(*) AS total_runs,
    COUNT(*) FILTER (WHERE status = 'completed') AS completed_runs, COUNT(*) FILTER (WHERE status = 'failed') AS failed_runs,
    COUNT(*) FILTER (WHERE status = 'active') AS active_runs, COUNT(*) FILTER (WHERE status = 'waiting') AS waiting_runs,
    CAST(COALESCE(SUM(took) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS duration_total_ms,
    COUNT(took) FILTER (WHERE status = 'completed') AS duration_count,
    CAST(MIN(took) FILTER (WHERE status = 'completed') AS INTEGER) AS duration_min_ms,
    CAST(MAX(took) FILTER (WHERE status = 'completed') AS INTEGER) AS duration_max_ms,
    CAST(COALESCE(SUM(waited) FILTER (WHERE {_FINISHED}), 0) AS BIGINT) AS pressure_total_ms,
    COUNT(*) FILTER (WHERE {_FINISHED}) AS pressure_count, {AS_OF} AS updated_at
  FROM (SELECT *, date_diff('millisecond', started_at, finished_at) AS took, date_diff('millisecond', enqueued_at, started_at) AS waited
        FROM folded) GROUP BY 1, 2""", valid=_VALID, folded=_fold_sql("valid")))
def rollup_by_deltas(spark, sf):
    """Statistics of the first half of the messages, brought up to date by what the second half changes."""
    stored, fresh = _two_halves(spark, sf)
    runs, hours = shared_dir(spark, "runs"), shared_dir(spark, "hours")
    tables.write_runs(stored, runs, versioned=True)
    tables.write_rollup(hourly_rollup(tables.read_table(spark, runs), fx.AS_OF), hours, versioned=True)
    changes = tables.upsert_table(runs, fresh, images=True)
    deltas.maintain(spark, hours, changes, tables.read_table(spark, runs), fx.AS_OF)
    return tables.read_table(spark, hours).drop("bucket_date")


@query(FOLD_CHECK)
def upsert_versioned_table(spark, sf):
    """Both halves upserted into a table that is replaced atomically."""
    path = shared_dir(spark, "runs")
    first, second = _two_halves(spark, sf)
    tables.write_runs(first, path, versioned=True)
    tables.upsert_table(path, second)
    Versioned(spark, path).vacuum()
    return folded_columns(tables.read_table(spark, path))


@query(check(f"SELECT {_ID} AS id, status, op FROM after WHERE op <> 'keep'", **_UPSERT))
def upsert_changed_rows(spark, sf):
    changes = up.upsert_changes(*_two_halves(spark, sf))
    return changes.select("id", "status", F.col(up.OP).alias("op"))


@query(check(f"SELECT {_ID} AS id, status FROM after WHERE op <> 'keep'", **_UPSERT))
def change_feed(spark, sf):
    return up.change_feed(up.upsert_changes(*_two_halves(spark, sf)))


@query(check(f"""
  SELECT seq, queue, job_id, created_at AS enqueued_at FROM valid WHERE created_at >= {AS_OF} - INTERVAL 12 DAY""",
             valid=_VALID))
def late_events_dropped(spark, sf):
    kept = up.within_retention(_events(spark, sf), fx.AS_OF, timedelta(days=12))
    return kept.select("seq", "queue", "job_id", "enqueued_at")


# Log resolution.

_LINES = """
  SELECT *, row_number() OVER (PARTITION BY queue, job_id, job_timestamp, log_timestamp, log_seq ORDER BY seq) AS copy_no
  FROM log_messages WHERE reject_reason IS NULL"""
_ATTACHED = """
  SELECT l.*, r.id AS job_run_id FROM lines l LEFT JOIN runs r
    ON r.queue = l.queue AND r.job_id = l.job_id AND r.enqueued_at = l.job_timestamp WHERE copy_no = 1"""
RESOLVED_CHECK = check(f"""
  SELECT {uuid_sql("job_run_id", "CAST(epoch_ms(log_timestamp) AS VARCHAR)", "CAST(log_seq AS VARCHAR)")} AS id,
    job_run_id, level, message, log_timestamp AS ts, log_seq
  FROM attached WHERE job_run_id IS NOT NULL""", lines=_LINES, attached=_ATTACHED)
_BUFFER_ID = uuid_sql("queue", "job_id", "CAST(epoch_ms(job_timestamp) AS VARCHAR)",
                      "CAST(epoch_ms(log_timestamp) AS VARCHAR)", "CAST(log_seq AS VARCHAR)")
BUFFERED_CHECK = check(f"""
  SELECT {_BUFFER_ID} AS id, queue, job_id, job_timestamp, log_timestamp, log_seq, level, message, {AS_OF} AS created_at
  FROM attached WHERE job_run_id IS NULL""", lines=_LINES, attached=_ATTACHED)


LOST_CHECK = check("""
  SELECT queue, job_id, job_timestamp, log_timestamp, log_seq, level, message FROM attached WHERE job_run_id IS NULL""",
                   lines=_LINES, attached=_ATTACHED)
DRAINED_CHECK = check("SELECT 'stored' AS place, COUNT(*) AS lines FROM lines WHERE copy_no = 1", lines=_LINES)


def _lines(spark, sf) -> DataFrame:
    events = valid_rows(parse_log_messages(fx.log_messages(spark, sf)))
    return lg.first_of_each(events, lg.BUFFER_KEY, "seq")


def _attached(spark, sf) -> DataFrame:
    return lg.attach_runs(_lines(spark, sf), fx.job_runs(spark, sf))


@query(RESOLVED_CHECK)
def logs_resolved(spark, sf):
    return lg.resolved(_attached(spark, sf))


@query(BUFFERED_CHECK)
def logs_buffered(spark, sf):
    return lg.unresolved(_attached(spark, sf), fx.AS_OF)


@query(check(f"""
  SELECT id, job_run_id, level, message, ts, log_seq FROM ({{resolved}}) x
  WHERE NOT EXISTS (SELECT 1 FROM logs l WHERE l.job_run_id = x.job_run_id AND l.ts = x.ts AND l.log_seq = x.log_seq
    AND l.level = 'log')""".replace("{resolved}", f"""
  SELECT {uuid_sql("job_run_id", "CAST(epoch_ms(log_timestamp) AS VARCHAR)", "CAST(log_seq AS VARCHAR)")} AS id,
    job_run_id, level, message, log_timestamp AS ts, log_seq FROM attached WHERE job_run_id IS NOT NULL"""),
             lines=_LINES, attached=_ATTACHED))
def logs_insert_ignore(spark, sf):
    """Lines that a table holding the ordinary ones already would take in."""
    stored = fx.job_logs(spark, sf).filter("level = 'log'")
    return lg.not_yet_stored(lg.resolved(_attached(spark, sf)), stored).select(*lg.LOG_COLUMNS)


# The buffer: all lines wait, stamped with their own time; part of the runs is known.

_BUFFER_STEPS = {
    "lines": _LINES,
    "buffer": f"SELECT {_BUFFER_ID} AS id, *, log_timestamp + INTERVAL 1 DAY AS waiting_since FROM lines WHERE copy_no = 1",
    "drained": f"""
      SELECT b.id, r.id AS job_run_id, waiting_since AS created_at, epoch_ms({AS_OF}) - epoch_ms(waiting_since) AS age_ms
      FROM buffer b LEFT JOIN (SELECT * FROM runs WHERE status <> 'active') r
        ON r.queue = b.queue AND r.job_id = b.job_id AND r.enqueued_at = b.job_timestamp""",
}


def _buffer(spark, sf) -> DataFrame:
    waiting = lg.unresolved(_lines(spark, sf).withColumn("job_run_id", F.lit(None).cast("string")), datetime(2024, 1, 1))
    return waiting.withColumn("created_at", F.expr("log_timestamp + interval 1 day"))


def _drained(spark, sf) -> DataFrame:
    return lg.drain(_buffer(spark, sf), fx.job_runs(spark, sf).filter("status <> 'active'"), fx.AS_OF)


@query(check("SELECT id, job_run_id, age_ms, job_run_id IS NULL AND age_ms >= 3600000 AS is_orphan FROM drained",
             **_BUFFER_STEPS))
def buffer_drain(spark, sf):
    return _drained(spark, sf).select("id", "job_run_id", "age_ms", "is_orphan")


@query(check("SELECT id FROM drained WHERE job_run_id IS NULL", **_BUFFER_STEPS))
def buffer_remaining(spark, sf):
    return lg.still_buffered(_buffer(spark, sf), _drained(spark, sf)).select("id")


@query(check(f"""
  SELECT COUNT(*) AS backlog, MIN(created_at) AS oldest_created_at,
    epoch_ms({AS_OF}) - epoch_ms(MIN(created_at)) AS oldest_age_ms, COUNT(job_run_id) AS resolved,
    COUNT(*) - COUNT(job_run_id) AS unresolved FROM drained""", **_BUFFER_STEPS))
def buffer_backlog(spark, sf):
    return lg.backlog(_drained(spark, sf), fx.AS_OF)


@query(check("""
  SELECT id, waiting_since AS created_at FROM buffer
  ORDER BY waiting_since, queue, job_id, job_timestamp, log_timestamp, log_seq LIMIT 1000""", **_BUFFER_STEPS))
def buffer_oldest(spark, sf):
    return lg.oldest(_buffer(spark, sf)).select("id", "created_at")
