"""Queries over reconciliation, commands, retention and the audit."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.operators import audit, commands as cmd, reconcile as rc, retention as rt, tags as tg
from runloom.operators.rollup import hourly_rollup
from runloom.plans import fixture as fx
from runloom.plans.checks import AS_OF, check
from runloom.plans.registry import query
from runloom.session import shared_dir
from runloom.sources import tables

# Snapshots.

@query(check("""SELECT DISTINCT queue AS name FROM jobs UNION SELECT DISTINCT 'w' || user_id % 9 FROM jobs"""))
def queue_discovery(spark, sf):
    """Queue names out of broker keys of every shape; some name no queue."""
    keys = fx.jobs(spark, sf).select(F.explode(F.array(
        F.concat(F.lit("bull:"), F.col("queue"), F.lit(":id")),
        F.concat(F.lit("bull:"), F.col("worker_id")),
        F.concat(F.lit("stray-"), F.col("job_id")),
    )).alias("key"))
    return rc.discover_queues(keys)


_NEW_QUEUES = """
  SELECT name, CASE WHEN no % 5 = 0 THEN '{"attempts":5}' ELSE '{"attempts":3}' END AS default_job_options,
    no % 3 = 0 AS is_paused
  FROM queues WHERE no < 8
  UNION ALL SELECT DISTINCT 'new-' || name, '{}', false FROM jobs"""


def _queue_snapshot(spark, sf) -> DataFrame:
    number = F.expr("cast(substring(name, 2) as int)")
    seen = fx.queues(spark, sf).filter(number < 8).select(
        "name",
        # Same content as stored, written differently where it has not changed.
        F.when(number % 5 == 0, F.lit('{"attempts":5}')).otherwise(F.lit('{ "attempts" : 3.0 }')).alias("default_job_options"),
        (number % 3 == 0).alias("is_paused"),
    )
    fresh = fx.jobs(spark, sf).select(F.concat(F.lit("new-"), F.col("name")).alias("name")).distinct()
    return seen.unionByName(fresh.select("name", F.lit("{}").alias("default_job_options"), F.lit(False).alias("is_paused")))


def _queue_diff_check(gone: str) -> str:
    return check(
        f"""SELECT name, is_paused, op, CASE WHEN op = 'update' THEN changed ELSE '' END AS changed_keys FROM (
              SELECT name, is_paused, changed, CASE WHEN new IS NULL THEN '{gone}' WHEN old IS NULL THEN 'insert'
                WHEN changed <> '' THEN 'update' ELSE 'keep' END AS op FROM both_sides)""",
        snapshot=_NEW_QUEUES,
        both_sides="""
          SELECT COALESCE(s.name, n.name) AS name, COALESCE(n.is_paused, s.is_paused) AS is_paused, s.name AS old, n.name AS new,
            concat_ws(',', CASE WHEN s.default_job_options <> n.default_job_options THEN 'default_job_options' END,
              CASE WHEN s.is_paused <> n.is_paused THEN 'is_paused' END) AS changed
          FROM queues s FULL JOIN snapshot n ON s.name = n.name""",
    )


def _queue_diff(spark, sf, complete: bool) -> DataFrame:
    diff = rc.diff_queues(fx.queues(spark, sf), _queue_snapshot(spark, sf), complete)
    return diff.select("name", "is_paused", F.col("_op").alias("op"), F.array_join("changed_keys", ",").alias("changed_keys"))


@query(_queue_diff_check("delete"))
def queue_snapshot_diff(spark, sf):
    return _queue_diff(spark, sf, complete=True)


@query(_queue_diff_check("keep"))
def queue_snapshot_incomplete(spark, sf):
    return _queue_diff(spark, sf, complete=False)


@query(check("""
  SELECT COALESCE(s.key, n.key) AS key,
    CASE WHEN s.key IS NULL THEN 'insert' WHEN n.key IS NULL AND q.name IS NOT NULL THEN 'delete'
      WHEN n.key IS NULL THEN 'keep' WHEN s.every IS DISTINCT FROM n.every OR s.tz <> n.tz THEN 'update' ELSE 'keep' END AS op,
    CASE WHEN s.key IS NULL OR n.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN s.tz <> n.tz THEN 'tz' END,
      CASE WHEN s.every IS DISTINCT FROM n.every THEN 'every' END) END AS changed_keys
  FROM schedulers s FULL JOIN snapshot n ON s.key = n.key
    LEFT JOIN scanned q ON q.id = s.queue_id""",
             scanned="SELECT * FROM queues WHERE no <> 8",
             snapshot="""
               SELECT key, CASE WHEN every = 6000 THEN 7000 ELSE every END AS every,
                 CASE WHEN queue = 'q4' THEN 'CET' ELSE tz END AS tz
               FROM schedulers JOIN scanned ON scanned.name = queue WHERE key NOT LIKE 's-q2-%'
               UNION ALL SELECT DISTINCT 'n-' || name, 500, 'UTC' FROM jobs"""))
def scheduler_snapshot_diff(spark, sf):
    """Lists of all queues but one: some changed, some gone, some new."""
    stored, all_queues = fx.schedulers(spark, sf), fx.queues(spark, sf)
    scanned = all_queues.filter("name <> 'q8'")
    names = all_queues.select(F.col("id").alias("queue_id"), F.col("name").alias("queue"))
    known = stored.join(names, "queue_id").filter("queue <> 'q8' and key not like 's-q2-%'").select(
        "queue", "key", "name", "limit", "end_date",
        F.when(F.col("queue") == "q4", F.lit("CET")).otherwise(F.col("tz")).alias("tz"), "pattern",
        F.when(F.col("every") == 6000, F.lit(7000)).otherwise(F.col("every")).alias("every"),
        F.lit('{"name" : "nightly"}').alias("template"),
    )
    fresh = fx.jobs(spark, sf).select("name").distinct().select(
        F.lit("q1").alias("queue"), F.concat(F.lit("n-"), F.col("name")).alias("key"), "name", F.lit("UTC").alias("tz"),
        F.lit(500).alias("every"),
    )
    snapshot = known.unionByName(fresh, allowMissingColumns=True)
    diff = rc.diff_schedulers(stored, snapshot, scanned)
    return diff.select("key", F.col("_op").alias("op"), F.array_join("changed_keys", ",").alias("changed_keys"))


# Live jobs: the runs whose worker number is not 3, some of them further along.

_LIVE = """
  SELECT *, CASE WHEN status IN ('completed', 'failed') THEN status WHEN worker_id = 'w5' THEN 'delayed'
    WHEN worker_id = 'w6' AND status = 'waiting' THEN 'paused' ELSE status END AS state
  FROM runs WHERE worker_id <> 'w3'"""


def _live(spark, sf) -> DataFrame:
    state = F.expr("""case when status in ('completed', 'failed') then status when worker_id = 'w5' then 'delayed'
                        when worker_id = 'w6' and status = 'waiting' then 'paused' else status end""")
    return fx.job_runs(spark, sf).filter("worker_id <> 'w3'").withColumn("state", state)


@query(check("SELECT id, 'update' AS op, 'delayed' AS status FROM live WHERE state = 'delayed'", live=_LIVE))
def reconcile_live(spark, sf):
    changes = rc.reconcile_live(fx.job_runs(spark, sf), _live(spark, sf))
    return changes.select("id", F.col("_op").alias("op"), "status")


@query(check("""
  SELECT id, queue, job_id, status AS old_status, 'unknown' AS status FROM runs
  WHERE status NOT IN ('completed', 'failed')
    AND NOT EXISTS (SELECT 1 FROM live WHERE live.queue = runs.queue AND live.job_id = runs.job_id)""", live=_LIVE))
def reconcile_unknown(spark, sf):
    return rc.reconcile_missing(fx.job_runs(spark, sf), _live(spark, sf), fx.queues(spark, sf))


@query(check(f"""
  SELECT r.id, r.queue, r.job_id, r.status AS old_status, state AS live_state,
    CASE WHEN state IS NULL THEN 'fail' ELSE 'resend' END AS action,
    CASE WHEN state IS NULL THEN 'failed' ELSE r.status END AS status,
    CASE WHEN state IS NULL THEN 'Job stalled' END AS error_message
  FROM runs r LEFT JOIN live USING (id)
  WHERE r.status IN ('active', 'waiting') AND r.created_at <= {AS_OF} - INTERVAL 1 DAY AND state IS DISTINCT FROM r.status""",
             live=_LIVE))
def stalled_sweep(spark, sf):
    return rc.stalled(fx.job_runs(spark, sf), _live(spark, sf), fx.AS_OF, fx.queues(spark, sf))


_SCANNED = "name not in ('q3', 'q7')"


@query(check("""
  SELECT id, queue, job_id, status AS old_status, 'unknown' AS status FROM runs
  WHERE status NOT IN ('completed', 'failed') AND queue NOT IN ('q3', 'q7')
    AND NOT EXISTS (SELECT 1 FROM live WHERE live.queue = runs.queue AND live.job_id = runs.job_id)""", live=_LIVE))
def reconcile_unknown_partial(spark, sf):
    """Two queues could not be read: nothing is said about their runs."""
    return rc.reconcile_missing(fx.job_runs(spark, sf), _live(spark, sf), fx.queues(spark, sf).filter(_SCANNED))


@query(check(f"""
  SELECT r.id, CASE WHEN state IS NULL THEN 'fail' ELSE 'resend' END AS action
  FROM runs r LEFT JOIN live USING (id)
  WHERE r.status IN ('active', 'waiting') AND r.created_at <= {AS_OF} - INTERVAL 1 DAY AND state IS DISTINCT FROM r.status
    AND r.queue NOT IN ('q3', 'q7')""", live=_LIVE))
def stalled_partial(spark, sf):
    found = rc.stalled(fx.job_runs(spark, sf), _live(spark, sf), fx.AS_OF, fx.queues(spark, sf).filter(_SCANNED))
    return found.select("id", "action")


@query(check("""
  SELECT id, CASE WHEN status NOT IN ('completed', 'failed')
      AND NOT EXISTS (SELECT 1 FROM live WHERE live.queue = runs.queue AND live.job_id = runs.job_id)
    THEN 'unknown' ELSE status END AS status, error_message FROM runs""", live=_LIVE))
def reconcile_applied(spark, sf):
    """The stored runs after the outcomes of a reconciliation were put on them."""
    path = shared_dir(spark, "runs")
    tables.write_runs(fx.job_runs(spark, sf), path)
    stored = tables.read_table(spark, path)
    lost = rc.reconcile_missing(stored, _live(spark, sf), fx.queues(spark, sf))
    tables.apply_outcomes(path, lost.select("id", "status", F.lit(None).cast("string").alias("error_message")))
    return tables.read_table(spark, path).select("id", "status", "error_message")


# Commands: one per job, with the queue spelled in several ways.

_COMMANDS = """
  SELECT DISTINCT job_id, CASE event_id % 4 WHEN 0 THEN '{' || queue || '}' WHEN 1 THEN 'no-' || queue ELSE queue END
    AS queue_name, queue AS own_queue
  FROM (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 'x' || job_id ELSE job_id END AS job_id) FROM jobs)"""


def _commands(spark, sf) -> DataFrame:
    return fx.jobs(spark, sf).selectExpr(
        "case when event_id % 5 = 0 then 'x' || job_id else job_id end as job_id",
        "case event_id % 4 when 0 then '{' || queue || '}' when 1 then 'no-' || queue else queue end as queue_name",
    )


@query(check("""
  SELECT DISTINCT queue_name, CASE WHEN queue_name NOT LIKE 'no-%' THEN own_queue END AS resolved FROM commands""",
             commands=_COMMANDS))
def resolve_queue_names(spark, sf):
    return cmd.resolve_queue_names(_commands(spark, sf), fx.queues(spark, sf))


@query(check("""
  SELECT queue_name, c.job_id, r.id, outcome,
    CASE WHEN outcome = 'cancelled' THEN 'failed' ELSE status END AS status,
    CASE WHEN outcome = 'cancelled' THEN 'Job cancelled' ELSE error_message END AS error_message
  FROM commands c LEFT JOIN runs r ON r.queue = own_queue AND r.job_id = c.job_id AND queue_name NOT LIKE 'no-%',
    LATERAL (SELECT CASE WHEN queue_name LIKE 'no-%' THEN 'queue_not_found' WHEN r.id IS NULL THEN 'job_not_found'
      WHEN status IN ('completed', 'failed') THEN 'already_finished' ELSE 'cancelled' END AS outcome)""",
             commands=_COMMANDS))
def cancel_jobs(spark, sf):
    return cmd.cancel_jobs(_commands(spark, sf), fx.job_runs(spark, sf), fx.queues(spark, sf))


_NAMED = "SELECT '{' || queue || '}' AS queue_name FROM jobs WHERE event_type = 'error' AND user_id % 12 < 5"


def _named(spark, sf) -> DataFrame:
    rows = fx.jobs(spark, sf).filter("event_type = 'error' and user_id % 12 < 5")
    return rows.selectExpr("'{' || queue || '}' as queue_name")


@query(check("SELECT name, is_paused OR no < 5 AS is_paused FROM queues"))
def pause_queues(spark, sf):
    return cmd.set_paused(_named(spark, sf), fx.queues(spark, sf), True).select("name", "is_paused")


@query(check("SELECT name, is_paused AND no >= 5 AS is_paused FROM queues"))
def resume_queues(spark, sf):
    return cmd.set_paused(_named(spark, sf), fx.queues(spark, sf), False).select("name", "is_paused")


@query(check("""
  SELECT 'queue' AS kind, name FROM queues WHERE no >= 5
  UNION ALL SELECT 'scheduler', key FROM schedulers JOIN queues ON queues.id = queue_id WHERE no >= 5"""))
def delete_queues(spark, sf):
    kept, schedulers = cmd.delete_queues(_named(spark, sf), fx.queues(spark, sf), fx.schedulers(spark, sf))
    return kept.select(F.lit("queue").alias("kind"), "name").unionByName(
        schedulers.select(F.lit("scheduler").alias("kind"), F.col("key").alias("name"))
    )


_OPTS = """'{"attempts":3,"backoff":{"delay":1000,"type":"fixed"},"priority":' || user_id || '}'"""


def _broker_jobs(spark, sf) -> DataFrame:
    opts = """'{"attempts":3,"jobId":"' || job_id || '","delay":' || cast(delay_ms as string)
      || ',"timestamp":' || cast(_created_ms as string) || ',"repeat":{"every":5},"repeatJobKey":"k",'
      || '"backoff":{"type":"fixed","delay":1000},"priority":' || cast(user_id as string) || '}'"""
    return fx.jobs(spark, sf).selectExpr("queue", "job_id", "name", "data", f"{opts} as opts")


_REPLAYED = f"""
  SELECT queue, name, props AS data, {_OPTS} AS opts, data AS plain FROM jobs
  WHERE event_id % 4 <> 1 AND event_id % 5 <> 0"""


@query(check("SELECT queue, name, data, opts FROM replayed", replayed=_REPLAYED))
def replay_set(spark, sf):
    rows = cmd.replay_set(_commands(spark, sf), _broker_jobs(spark, sf), fx.queues(spark, sf))
    return rows.withColumn("opts", F.to_json(F.try_parse_json("opts")))


@query(check("""
  SELECT queue AS key, '{"queue":"' || queue || '","name":"' || name || '","data":' || plain || ',"opts":' || opts || '}'
    AS value FROM replayed""", replayed=_REPLAYED))
def enqueue_messages(spark, sf):
    return cmd.enqueue_messages(cmd.replay_set(_commands(spark, sf), _broker_jobs(spark, sf), fx.queues(spark, sf)))


# Retention.

_KEEP = timedelta(days=9, hours=12)
_CUT = f"{AS_OF} - INTERVAL 228 HOUR"


@query(check(f"SELECT id, created_at FROM runs WHERE created_at >= {_CUT}"))
def retention_runs(spark, sf):
    return rt.keep_runs(fx.job_runs(spark, sf), fx.AS_OF, _KEEP).select("id", "created_at")


@query(check(f"SELECT id, created_at FROM runs WHERE created_at >= {_CUT}"))
def retention_runs_stored(spark, sf):
    """Whole dates dropped from a stored table, the boundary date cut."""
    path = shared_dir(spark, "runs")
    tables.write_runs(fx.job_runs(spark, sf), path)
    tables.delete_before(spark, path, "created_date", "created_at", fx.AS_OF - _KEEP)
    return tables.read_table(spark, path).select("id", "created_at")


@query(check(f"""
  SELECT 'run' AS kind, id FROM runs WHERE created_at >= {_CUT}
  UNION ALL SELECT 'line', logs.id FROM logs JOIN runs ON runs.id = job_run_id WHERE created_at >= {_CUT}"""))
def retention_logs_stored(spark, sf):
    """Old runs deleted from stored tables, their log lines with them, in one step for each table."""
    runs, logs = shared_dir(spark, "runs"), shared_dir(spark, "logs")
    tables.write_runs(fx.job_runs(spark, sf), runs, versioned=True)
    tables.write_logs(fx.job_logs(spark, sf), logs, versioned=True)
    tables.delete_runs_before(spark, runs, logs, fx.AS_OF - _KEEP)
    kept = tables.read_table(spark, runs).select(F.lit("run").alias("kind"), "id")
    return kept.union(tables.read_table(spark, logs).select(F.lit("line"), "id"))


@query(check(f"SELECT * FROM rollup WHERE bucket_start >= {_CUT}"))
def retention_rollups_stored(spark, sf):
    """Old hours deleted from a stored table: earlier dates leave its list, the boundary date is cut."""
    path = shared_dir(spark, "hours")
    tables.write_rollup(hourly_rollup(fx.job_runs(spark, sf), fx.AS_OF), path, versioned=True)
    tables.delete_before(spark, path, "bucket_date", "bucket_start", fx.AS_OF - _KEEP)
    return tables.read_table(spark, path).drop("bucket_date")


@query(check(f"""
  SELECT tag, last_seen_at FROM (SELECT tag, MAX(created_at) AS last_seen_at FROM (SELECT unnest(tags) AS tag, created_at FROM runs)
    GROUP BY tag) WHERE last_seen_at >= {_CUT}"""))
def retention_tags_stored(spark, sf):
    """Tags not seen for long deleted from the stored catalogue."""
    path = shared_dir(spark, "tags")
    tables.write_tags(tg.tag_catalogue(fx.job_runs(spark, sf), fx.AS_OF), path)
    tables.delete_tags_before(spark, path, fx.AS_OF - _KEEP)
    return tables.read_table(spark, path).select("tag", "last_seen_at")


@query(check("SELECT id, job_run_id, level, message, ts, log_seq FROM logs"))
def logs_stored_twice(spark, sf):
    """Log lines written, and written again as after a failure."""
    path = shared_dir(spark, "logs")
    for _ in range(2):
        tables.write_logs(fx.job_logs(spark, sf), path)
    return tables.read_table(spark, path).select("id", "job_run_id", "level", "message", "ts", "log_seq")


@query(check("SELECT * FROM rollup"))
def rollup_stored(spark, sf):
    """Hourly statistics as stored, after one hour of each kind was computed again."""
    path, runs = shared_dir(spark, "rollup"), fx.job_runs(spark, sf)
    tables.write_rollup(hourly_rollup(runs, fx.AS_OF), path)
    again = hourly_rollup(runs.filter(F.date_trunc("hour", "created_at") == F.lit("2024-01-05 10:00:00").cast("timestamp")), fx.AS_OF)
    tables.write_rollup_hour(again, path, datetime(2024, 1, 5, 10))
    return tables.read_table(spark, path).drop("bucket_date")


@query(check(f"SELECT logs.id FROM logs JOIN runs ON runs.id = job_run_id WHERE created_at >= {_CUT}"))
def retention_logs(spark, sf):
    return rt.keep_logs(fx.job_logs(spark, sf), fx.job_runs(spark, sf), fx.AS_OF, _KEEP).select("id")


@query(check(f"SELECT bucket_start, queue, total_runs FROM rollup WHERE bucket_start >= {_CUT}"))
def retention_rollups(spark, sf):
    rollup = hourly_rollup(fx.job_runs(spark, sf), fx.AS_OF)
    return rt.keep_rollup(rollup, fx.AS_OF, _KEEP).select("bucket_start", "queue", "total_runs")


@query(check(f"""
  SELECT tag, MAX(created_at) AS last_seen_at FROM (SELECT 'day ' || day(created_at) AS tag, created_at FROM runs)
  GROUP BY tag HAVING MAX(created_at) >= {_CUT}"""))
def retention_tags(spark, sf):
    daily = fx.job_runs(spark, sf).withColumn(
        "tags", F.array(F.concat(F.lit("day "), F.dayofmonth("created_at").cast("string")))
    )
    return rt.keep_tags(tg.tag_catalogue(daily, fx.AS_OF), fx.AS_OF, _KEEP).select("tag", "last_seen_at")


# Audit: every event is an expected job of one test run; what arrived is lacking in known ways.

_RUN = "stress-1"
_EXPECTED = """SELECT event_id, job_id, event_id AS index, (event_id * 37) % 5000 AS wait, event_type = 'error' AS should_fail,
  CAST(user_id % 50 AS INTEGER) AS payload_length FROM jobs"""
_ARRIVED = """
  SELECT *, event_id % 41 = 0 AS lost, event_id % 43 = 0 AS wrong,
    CASE WHEN event_id % 47 = 0 THEN CASE WHEN should_fail THEN 'completed' ELSE 'failed' END
      WHEN event_id % 53 = 0 THEN 'active' WHEN should_fail THEN 'failed' ELSE 'completed' END AS status FROM expected"""


def _audited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expected jobs, the runs that arrived, and their log lines."""
    jobs = fx.jobs(spark, sf)
    expected = jobs.selectExpr(
        "job_id", "event_id as index", "(event_id * 37) % 5000 as wait", "event_type = 'error' as should_fail",
        "cast(user_id % 50 as int) as payload_length",
    )
    data = """'{"wait":' || cast((event_id * 37) % 5000 + if(event_id % 43 = 0, 1, 0) as string)
      || ',"shouldFail":' || if(event_type = 'error', 'true', 'false') || ',"stress":{"index":' || cast(event_id as string)
      || ',"runId":"stress-1"' || if(user_id % 50 = 0, '', ',"payload":"' || repeat('x', cast(user_id % 50 as int)) || '"') || '}}'"""
    status = """case when event_id % 47 = 0 then if(event_type = 'error', 'completed', 'failed')
      when event_id % 53 = 0 then 'active' when event_type = 'error' then 'failed' else 'completed' end"""
    arrived = jobs.filter("event_id % 41 <> 0").selectExpr(
        "job_id as id", "job_id", "'{demo}' as queue", "'stress' as name", f"{status} as status", f"{data} as data", "created_at"
    )
    logs = arrived.selectExpr("id as job_run_id", "explode(array(0, 1)) as log_seq")
    return expected, arrived, logs


@query(check("""
  SELECT COUNT(*) AS expected_jobs, COUNT(*) FILTER (WHERE NOT lost) AS found_jobs,
    COUNT(*) FILTER (WHERE lost) AS missing_jobs, COUNT(*) FILTER (WHERE should_fail) AS expected_failed,
    COUNT(*) FILTER (WHERE NOT should_fail) AS expected_completed,
    COUNT(*) FILTER (WHERE NOT lost AND status = 'completed') AS completed,
    COUNT(*) FILTER (WHERE NOT lost AND status = 'failed') AS failed,
    COUNT(*) FILTER (WHERE NOT lost AND status <> 'active') AS terminal,
    COUNT(*) FILTER (WHERE NOT lost AND wrong) + COUNT(*) FILTER (WHERE NOT lost AND event_id % 47 = 0) AS mismatches,
    2 * COUNT(*) FILTER (WHERE NOT lost) AS found_logs, 2 * COUNT(*) AS expected_logs, false AS verified
  FROM arrived""", expected=_EXPECTED, arrived=_ARRIVED))
def replication_audit(spark, sf):
    expected, runs, logs = _audited(spark, sf)
    return audit.tallies(audit.compare(expected, runs, _RUN, "{demo}", "stress"), logs, runs, _RUN)


@query(check("""
  SELECT job_id, status, 'payload_mismatch' AS reason FROM arrived WHERE NOT lost AND wrong
  UNION ALL SELECT job_id, status, CASE WHEN should_fail THEN 'missed_failure' ELSE 'unexpected_failure' END
    FROM arrived WHERE NOT lost AND event_id % 47 = 0""", expected=_EXPECTED, arrived=_ARRIVED))
def audit_mismatches(spark, sf):
    expected, runs, _ = _audited(spark, sf)
    return audit.mismatches(audit.compare(expected, runs, _RUN, "{demo}", "stress"))
