"""DuckDB text of the derived tables, for the side-by-side checks.

Only names that a check uses are put in front of it.
"""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def uuid_sql(*parts: str) -> str:
    tagged = " || ".join(f"length({p}) || ':' || {p}" for p in parts)
    h = f"sha256({tagged})"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-8' || substr({h}, 13, 3)"
        f" || '-8' || substr({h}, 16, 3) || '-' || substr({h}, 19, 12)"
    )


_JOBS = """
  SELECT event_id, user_id, event_type, CAST(event_id AS VARCHAR) AS job_id,
    'q' || CAST(user_id % 12 AS VARCHAR) AS queue, event_type AS name,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'active'
      WHEN 'click' THEN 'waiting' ELSE 'completed' END AS status,
    CAST(event_id % 3 AS SMALLINT) AS attempt, CAST(3 AS SMALLINT) AS max_attempts,
    CASE WHEN user_id % 5 = 0 THEN CAST(user_id % 10 AS INTEGER) END AS priority,
    CAST((event_id % 4) * 250 AS INTEGER) AS delay_ms,
    CASE WHEN event_id % 2 = 0 THEN '{"delay":1000,"type":"fixed"}' END AS backoff,
    CASE WHEN user_id % 11 = 0 THEN 'repeat:' || CAST(user_id AS VARCHAR) END AS repeat_job_key,
    CASE WHEN event_id % 13 = 0 THEN CAST(event_id - 1 AS VARCHAR) END AS parent_job_id,
    'w' || CAST(user_id % 9 AS VARCHAR) AS worker_id,
    CASE WHEN user_id % 7 = 0 THEN CAST([] AS VARCHAR[])
      ELSE [event_type, 'seg' || CAST(user_id % 5 AS VARCHAR)] END AS tags,
    props, CAST(json(props) AS VARCHAR) AS data,
    CASE WHEN event_type IN ('signup', 'purchase') THEN '{"status":"done"}' END AS result,
    CASE WHEN event_type = 'error' THEN 'boom ' || CAST(user_id AS VARCHAR) END AS error_message,
    date_trunc('millisecond', ts) AS created_at,
    epoch_ms(date_trunc('millisecond', ts)) AS created_ms,
    CASE WHEN event_type <> 'click' THEN (event_id * 37) % 5000 END AS wait,
    CASE WHEN event_type IN ('error', 'signup', 'purchase')
      THEN (event_id * 37) % 5000 + CAST(floor(value * 100) AS BIGINT) END AS ends
  FROM events
"""

_RUNS = f"""
  SELECT {uuid_sql("queue", "job_id", "CAST(created_ms AS VARCHAR)")} AS id, job_id, queue, name, status, attempt,
    max_attempts, priority, delay_ms, backoff, repeat_job_key, parent_job_id, worker_id, tags, data, result,
    error_message, error_message || chr(10) || '    at work' AS error_stack, created_at,
    created_at AS enqueued_at, created_at + to_milliseconds(wait) AS started_at,
    created_at + to_milliseconds(ends) AS finished_at, CAST(ends - wait AS INTEGER) AS duration_ms,
    wait AS wait_ms, event_id
  FROM jobs
"""

_ROLLUP = f"""
  SELECT date_trunc('hour', created_at) AS bucket_start, queue, COUNT(*) AS total_runs,
    COUNT(*) FILTER (WHERE status = 'completed') AS completed_runs,
    COUNT(*) FILTER (WHERE status = 'failed') AS failed_runs,
    COUNT(*) FILTER (WHERE status = 'active') AS active_runs,
    COUNT(*) FILTER (WHERE status = 'waiting') AS waiting_runs,
    CAST(COALESCE(SUM(duration_ms) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS duration_total_ms,
    COUNT(duration_ms) FILTER (WHERE status = 'completed') AS duration_count,
    MIN(duration_ms) FILTER (WHERE status = 'completed') AS duration_min_ms,
    MAX(duration_ms) FILTER (WHERE status = 'completed') AS duration_max_ms,
    CAST(COALESCE(SUM(wait_ms) FILTER (WHERE status IN ('completed', 'failed')), 0) AS BIGINT) AS pressure_total_ms,
    COUNT(wait_ms) FILTER (WHERE status IN ('completed', 'failed')) AS pressure_count,
    {AS_OF} AS updated_at
  FROM runs GROUP BY 1, 2
"""

_QUEUES = f"""
  SELECT {uuid_sql("queue")} AS id, queue AS name, '{{"attempts":3}}' AS default_job_options,
    CAST(substr(queue, 2) AS INTEGER) % 4 = 0 AS is_paused, TIMESTAMP '2023-12-31 00:00:00' AS created_at,
    CAST(substr(queue, 2) AS INTEGER) AS no
  FROM (SELECT DISTINCT queue FROM jobs UNION ALL SELECT unnest(['q90', 'q91']))
"""

_SCHEDULERS = f"""
  SELECT {uuid_sql("key")} AS id, queue_id, key, 'nightly ' || queue AS name, CAST(NULL AS INTEGER) AS "limit",
    CAST(NULL AS TIMESTAMP) AS end_date, 'UTC' AS tz,
    CASE WHEN (no // 2 + copy) % 2 = 0 THEN '0 3 * * *' END AS pattern,
    CASE WHEN (no // 2 + copy) % 2 <> 0 THEN CAST(no * 1000 AS INTEGER) END AS every,
    '{{"name":"nightly"}}' AS template, queue
  FROM (SELECT id AS queue_id, name AS queue, no, copy, 's-' || name || '-' || copy AS key
        FROM queues, LATERAL (SELECT unnest(CASE WHEN name = 'q2' THEN [0, 1] ELSE [0] END) AS copy) WHERE no % 2 = 0)
"""

# Messages are not parsed here: their content follows from the job, so the
# check is independent of any JSON reading.
_MESSAGES = """
  SELECT *, seq >> 58 AS batch_id,
    CASE bad WHEN 1 THEN 'bad_json' WHEN 2 THEN 'bad_version' WHEN 3 THEN 'bad_queue_name' WHEN 4 THEN 'bad_job_id'
      WHEN 5 THEN 'bad_tags' WHEN 6 THEN 'bad_state' WHEN 7 THEN 'missing_payload'
      WHEN 8 THEN 'bad_timestamp' WHEN 9 THEN 'bad_processed_on' WHEN 10 THEN 'bad_finished_on' END AS reject_reason,
    CASE no WHEN 0 THEN 'waiting' WHEN 1 THEN 'active' ELSE status END AS event_status,
    CASE WHEN no = 0 THEN CAST([] AS VARCHAR[]) ELSE tags END AS event_tags,
    CASE WHEN no > 0 THEN created_at + to_milliseconds(wait) END AS event_started,
    CASE WHEN no = 2 THEN created_at + to_milliseconds(ends) END AS event_finished,
    CASE WHEN no = 2 THEN error_message END AS event_error,
    CASE WHEN no = 2 THEN result END AS event_result
  FROM (SELECT *, event_id % 97 AS bad, ((event_id * 8 + no * 2 + copy) % 65536) * 40503 % 65536 * 70368744177664 + (event_id * 8 + no * 2 + copy) // 65536 AS seq
        FROM (SELECT *, unnest(CASE WHEN event_id % 10 = 3 THEN [0, 1] ELSE [0] END) AS copy
              FROM (SELECT *, unnest([0, 1, 2]) AS no FROM jobs)
              WHERE no = 0 OR (no = 1 AND wait IS NOT NULL) OR (no = 2 AND ends IS NOT NULL)))
"""

_LOG_MESSAGES = """
  SELECT queue, CASE WHEN event_id % 50 = 7 THEN 'lost-' || job_id ELSE job_id END AS job_id, job_id AS own_job_id,
    created_at AS job_timestamp,
    created_at + to_milliseconds(CASE no WHEN 0 THEN wait ELSE ends END) AS log_timestamp,
    CAST(CASE WHEN no = 1 AND ends = wait THEN 1 ELSE 0 END AS INTEGER) AS log_seq,
    CASE WHEN no = 1 AND event_type = 'error' THEN 'error' ELSE 'log' END AS level,
    CASE WHEN no = 0 THEN 'Processing job ' || job_id
      WHEN event_type = 'error' THEN 'Job ' || job_id || ' failed intentionally'
      ELSE 'Job ' || job_id || ' processed' END AS message,
    worker_id, event_id, bad, seq, seq >> 58 AS batch_id, created_ms, job_id AS jid,
    CASE bad WHEN 1 THEN 'bad_json' WHEN 2 THEN 'bad_version' WHEN 3 THEN 'bad_queue_name'
      WHEN 6 THEN 'bad_level' WHEN 7 THEN 'missing_payload'
      WHEN 8 THEN 'bad_job_timestamp' WHEN 9 THEN 'bad_log_timestamp' END AS reject_reason
  FROM (SELECT *, event_id % 97 AS bad, ((event_id * 8 + no * 2 + copy) % 65536) * 40503 % 65536 * 70368744177664 + (event_id * 8 + no * 2 + copy) // 65536 AS seq
        FROM (SELECT *, unnest(CASE WHEN event_id % 10 = 3 THEN [0, 1] ELSE [0] END) AS copy
              FROM (SELECT *, unnest([0, 1]) AS no FROM jobs WHERE wait IS NOT NULL)
              WHERE no = 0 OR ends IS NOT NULL))
"""

_LOGS = f"""
  SELECT {uuid_sql("job_run_id", "CAST(epoch_ms(ts) AS VARCHAR)", "CAST(log_seq AS VARCHAR)")} AS id, *
  FROM (SELECT id AS job_run_id, CASE WHEN no = 1 AND status = 'failed' THEN 'error' ELSE 'log' END AS level,
          CASE WHEN no = 0 THEN 'Processing job ' || job_id
            WHEN status = 'failed' THEN 'Job ' || job_id || ' failed intentionally'
            ELSE 'Job ' || job_id || ' processed' END AS message,
          CASE no WHEN 0 THEN started_at ELSE finished_at END AS ts,
          CAST(CASE WHEN no = 1 AND started_at = finished_at THEN 1 ELSE 0 END AS INTEGER) AS log_seq, event_id
        FROM (SELECT *, unnest([0, 1]) AS no FROM runs WHERE started_at IS NOT NULL)
        WHERE no = 0 OR finished_at IS NOT NULL)
"""

_TABLES = {
    "jobs": _JOBS,
    "runs": _RUNS,
    "rollup": _ROLLUP,
    "queues": _QUEUES,
    "schedulers": _SCHEDULERS,
    "messages": _MESSAGES,
    "log_messages": _LOG_MESSAGES,
    "logs": _LOGS,
}


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"(?i)\b(from|join)\s+{name}\b", sql) is not None


def check(body: str, **steps: str) -> str:
    """One statement: the derived tables the body needs, its own steps, the body."""
    wanted: list[str] = []

    def need(sql: str) -> None:
        for name, text in _TABLES.items():
            if name not in wanted and name not in steps and _mentions(sql, name):
                need(text)
                wanted.append(name)

    for sql in [*steps.values(), body]:
        need(sql)
    parts = [f"{name} AS ({_TABLES[name].strip()})" for name in wanted]
    parts += [f"{name} AS ({sql.strip()})" for name, sql in steps.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()
