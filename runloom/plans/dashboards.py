"""Queries over the hourly statistics and the queue tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.functions.time import dashboard_window, pressure_bounds
from runloom.operators import dashboard, queues as q, rollup as r
from runloom.plans import fixture as fx
from runloom.plans.checks import AS_OF, check
from runloom.plans.registry import query

EARLIER = datetime(2024, 1, 30)


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return r.hourly_rollup(fx.job_runs(spark, sf), fx.AS_OF)


@query(check("SELECT * FROM rollup"))
def hourly_rollup(spark, sf):
    return _rollup(spark, sf)


@query(check(f"""
  SELECT * EXCLUDE (updated_at),
    CASE WHEN bucket_start = TIMESTAMP '2024-01-30 23:00:00' THEN {AS_OF}
      ELSE TIMESTAMP '2024-01-30 00:00:00' END AS updated_at
  FROM rollup"""))
def hourly_rollup_refresh(spark, sf):
    runs = fx.job_runs(spark, sf)
    stored = r.hourly_rollup(runs, EARLIER)
    return r.replace_hour(stored, r.refresh_hour(runs, fx.AS_OF), datetime(2024, 1, 30, 23))


@query(check("""
  SELECT * EXCLUDE (total_runs), total_runs + CASE WHEN hour(bucket_start) % 2 = 0 THEN 1000 ELSE 0 END AS total_runs
  FROM rollup"""))
def rollup_backfill_merge(spark, sf):
    """Old statistics without pressure, of the even hours only, completed by a back-fill."""
    runs = fx.job_runs(spark, sf)
    old = r.hourly_rollup(runs, EARLIER).filter(F.hour("bucket_start") % 2 == 0).withColumns({
        "total_runs": F.col("total_runs") + 1000,
        "pressure_total_ms": F.lit(0).cast("long"),
        "pressure_count": F.lit(0).cast("long"),
    })
    return r.backfill_pressure(old, runs, fx.AS_OF)


@query(check("""
  SELECT * FROM rollup WHERE bucket_start IN (
    SELECT date_trunc('hour', created_at) FROM runs WHERE error_message LIKE '%7')"""))
def rollup_touched_hours(spark, sf):
    runs = fx.job_runs(spark, sf)
    changed = runs.filter(F.col("error_message").like("%7"))
    return r.refresh_touched(runs, changed, fx.AS_OF)


_IN_30 = f"bucket_start BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF}"
_IN_7 = f"bucket_start BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}"


@query(check(f"""
  SELECT (SELECT COUNT(*) FROM runs WHERE status = 'active') AS running_tasks,
    (SELECT COUNT(*) FROM runs WHERE status = 'waiting') AS waiting_in_queue,
    CAST(COALESCE(SUM(completed_runs), 0) AS BIGINT) AS successes,
    CAST(COALESCE(SUM(failed_runs), 0) AS BIGINT) AS failures
  FROM rollup WHERE {_IN_7}"""))
def dashboard_totals(spark, sf):
    return dashboard.totals(fx.job_runs(spark, sf), _rollup(spark, sf), dashboard_window(fx.AS_OF, 7))


_PERFORMANCE = f"""
  SELECT queue, CAST(SUM(total_runs) AS BIGINT) AS total_runs, CAST(SUM(completed_runs) AS BIGINT) AS successes,
    CAST(SUM(failed_runs) AS BIGINT) AS failures,
    CAST(SUM(failed_runs) AS DOUBLE) / SUM(total_runs) * 100 AS error_rate,
    CASE WHEN SUM(duration_count) > 0
      THEN CAST(SUM(duration_total_ms) AS DOUBLE) / SUM(duration_count) / 1000 ELSE 0 END AS avg_duration,
    CAST(COALESCE(MIN(duration_min_ms), 0) AS DOUBLE) / 1000 AS min_duration,
    CAST(COALESCE(MAX(duration_max_ms), 0) AS DOUBLE) / 1000 AS max_duration
  FROM rollup WHERE {_IN_30} GROUP BY queue"""


def _performance(spark, sf):
    return dashboard.queue_performance(_rollup(spark, sf), dashboard_window(fx.AS_OF, 30))


@query(check(_PERFORMANCE))
def queue_performance(spark, sf):
    return _performance(spark, sf)


@query(check("SELECT * FROM performance ORDER BY error_rate, queue", performance=_PERFORMANCE))
def queue_performance_sorted(spark, sf):
    return dashboard.sort_performance(_performance(spark, sf), "error_rate", "asc")


@query(check("SELECT queue, total_runs AS run_count FROM performance ORDER BY total_runs DESC, queue LIMIT 10",
             performance=_PERFORMANCE))
def top_queues_count(spark, sf):
    return dashboard.top_by_count(_performance(spark, sf))


@query(check("""
  SELECT queue, avg_duration AS total_duration FROM performance WHERE avg_duration > 0
  ORDER BY avg_duration DESC, queue LIMIT 5""", performance=_PERFORMANCE))
def top_queues_duration(spark, sf):
    return dashboard.top_by_duration(_performance(spark, sf), 5)


def _graph(grain: str, days: int, cond: str) -> str:
    return check(
        """SELECT strftime(step, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(COALESCE(n, 0) AS BIGINT) AS run_count
           FROM steps LEFT JOIN counts USING (step)""",
        steps=f"SELECT unnest(generate_series({AS_OF} - INTERVAL {days} DAY, {AS_OF}, INTERVAL 1 {grain})) AS step",
        counts=f"SELECT date_trunc('{grain}', bucket_start) AS step, SUM(total_runs) AS n FROM rollup WHERE {cond} GROUP BY 1",
    )


@query(_graph("hour", 7, _IN_7))
def run_graph_hour(spark, sf):
    return dashboard.run_graph(_rollup(spark, sf), dashboard_window(fx.AS_OF, 7))


@query(_graph("day", 30, _IN_30))
def run_graph_day(spark, sf):
    return dashboard.run_graph(_rollup(spark, sf), dashboard_window(fx.AS_OF, 30))


_PRESSURE = f"""
  SELECT queue, CAST(round(CAST(SUM(pressure_total_ms) AS DOUBLE) / NULLIF(SUM(pressure_count), 0)) AS BIGINT) AS pressure
  FROM rollup WHERE bucket_start >= {AS_OF} - INTERVAL 30 DAY AND bucket_start < {AS_OF} GROUP BY queue"""


@query(check(_PRESSURE))
def queue_pressure(spark, sf):
    return dashboard.pressure_per_queue(_rollup(spark, sf), *pressure_bounds(fx.AS_OF, 30))


# Queue lists.

_COUNTS = """
  SELECT queue, COUNT(*) FILTER (WHERE status = 'waiting') AS waiting_jobs,
    COUNT(*) FILTER (WHERE status = 'active') AS active_jobs
  FROM runs WHERE status IN ('waiting', 'active') GROUP BY queue"""
_LISTS = """
  SELECT queue_id, array_to_string(list_sort(list(pattern) FILTER (pattern IS NOT NULL)), ',') AS patterns,
    array_to_string(list_sort(list(every) FILTER (every IS NOT NULL)), ',') AS everys
  FROM schedulers GROUP BY queue_id"""
_LISTED = """
  SELECT name, is_paused, COALESCE(patterns, '') AS patterns, COALESCE(everys, '') AS everys,
    COALESCE(waiting_jobs, 0) AS waiting_jobs, COALESCE(active_jobs, 0) AS active_jobs,
    COALESCE(pressure, 0) AS pressure
  FROM queues LEFT JOIN counts ON counts.queue = name LEFT JOIN weights ON weights.queue = name
    LEFT JOIN lists ON queue_id = id"""
_QUEUE_STEPS = {"counts": _COUNTS, "weights": _PRESSURE, "lists": _LISTS, "listed": _LISTED}


def _page_check(columns: str, where: str, order: str, limit: int, reverse: bool = False) -> str:
    position = "n" if not reverse else "COUNT(*) OVER () - n + 1"
    return check(
        f"SELECT {columns}, CAST({position} AS INTEGER) AS position FROM scan WHERE n <= {limit}",
        **_QUEUE_STEPS,
        scan=f"SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM listed WHERE {where} ORDER BY {order} LIMIT {limit}",
    )


def _flat(rows: DataFrame) -> DataFrame:
    """Arrays as text, for a comparison that does not depend on how engines show arrays."""
    return rows.withColumns({
        "patterns": F.array_join("patterns", ","),
        "everys": F.array_join(F.col("everys").cast("array<string>"), ","),
    })


def _queue_page(spark, sf, **options):
    start, end = pressure_bounds(fx.AS_OF, 30)
    return q.queues_page(
        fx.queues(spark, sf), fx.job_runs(spark, sf), fx.schedulers(spark, sf), _rollup(spark, sf),
        pressure_from=start, pressure_to=end, **options,
    )


_NO_PRESSURE = "name, is_paused, patterns, everys, waiting_jobs, active_jobs, CAST(0 AS BIGINT) AS pressure"


@query(_page_check(_NO_PRESSURE, "true", "waiting_jobs DESC, name", 5))
def queues_page_waiting(spark, sf):
    return _flat(_queue_page(spark, sf, limit=5).rows)


@query(_page_check(_NO_PRESSURE, "active_jobs > 1 OR (active_jobs = 1 AND name < 'q90')",
                   "active_jobs ASC, name DESC", 20, reverse=True))
def queues_page_active(spark, sf):
    """Going back from a place near the end of the descending list."""
    cursor = q.QueueCursor("q90", active_jobs=1)
    page = _queue_page(spark, sf, sort_by="active_jobs", sort_direction="desc", cursor=cursor, cursor_direction="prev")
    return _flat(page.rows)


@query(_page_check("name, is_paused, patterns, everys, waiting_jobs, active_jobs, pressure",
                   "(pressure = 0 AND name > 'q90') OR pressure > 0", "pressure ASC, name", 8))
def queues_page_pressure(spark, sf):
    cursor = q.QueueCursor("q90", pressure=0)
    page = _queue_page(spark, sf, sort_by="pressure", sort_direction="asc", cursor=cursor, limit=8)
    return _flat(page.rows)


@query(check("""
  SELECT l.name AS next_name, l.waiting_jobs AS next_waiting_jobs, l.active_jobs AS next_active_jobs,
    CAST(0 AS BIGINT) AS next_pressure, CAST(NULL AS VARCHAR) AS prev_name, CAST(NULL AS BIGINT) AS prev_waiting_jobs,
    CAST(NULL AS BIGINT) AS prev_active_jobs, CAST(NULL AS BIGINT) AS prev_pressure
  FROM (SELECT *, row_number() OVER (ORDER BY waiting_jobs DESC, name) AS n FROM listed) l WHERE n = 5""",
             **_QUEUE_STEPS))
def queues_page_cursors(spark, sf):
    return _queue_page(spark, sf, limit=5).cursors


@query(_page_check("name, is_paused, patterns, everys, waiting_jobs, active_jobs", "name ILIKE '%1%'",
                   "waiting_jobs DESC, name", 20))
def queues_agent_view(spark, sf):
    return q.agent_view(_flat(_queue_page(spark, sf, search="1").rows))


@query(_page_check("name, is_paused, patterns, everys, waiting_jobs, active_jobs, pressure", "true",
                   "waiting_jobs DESC, name", 6))
def queues_table(spark, sf):
    """A page by waiting jobs with the pressure filled in afterwards."""
    page = _queue_page(spark, sf, limit=6).rows
    return _flat(q.page_with_stats(page, _rollup(spark, sf), *pressure_bounds(fx.AS_OF, 30)))


@query(check("""SELECT id, name, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS position
  FROM queues WHERE name >= 'q3' ORDER BY name LIMIT 4"""))
def queue_names_page(spark, sf):
    return q.queue_names_page(fx.queues(spark, sf), cursor="q3", limit=4).rows


@query(check("""
  SELECT (SELECT name FROM queues WHERE name >= 'q5' ORDER BY name OFFSET 3 LIMIT 1) AS next_cursor,
    (SELECT name FROM (SELECT name, row_number() OVER (ORDER BY name DESC) AS n FROM queues WHERE name < 'q5')
     WHERE n = 3) AS prev_cursor"""))
def queue_names_cursors(spark, sf):
    return q.queue_names_page(fx.queues(spark, sf), cursor="q5", limit=3).cursors


@query(check("SELECT COUNT(*) AS total FROM queues WHERE name ILIKE '%Q1%'"))
def queue_total(spark, sf):
    return q.queue_total(fx.queues(spark, sf), "Q1")


@query(check(_COUNTS))
def live_counts(spark, sf):
    return q.live_counts(fx.job_runs(spark, sf))


def _chart_check(grain: str, days: int) -> str:
    now = "TIMESTAMP '2024-01-30 20:40:00'"
    start = f"date_trunc('{grain}', {now} - INTERVAL {days} DAY)"
    return check(
        """SELECT queue, strftime(step, '%Y-%m-%d %H:%M:%S') AS timestamp, COALESCE(completed, 0) AS completed,
             COALESCE(failed, 0) AS failed FROM steps LEFT JOIN points USING (queue, step)""",
        counts=_COUNTS,
        page="""SELECT name AS queue FROM queues LEFT JOIN counts ON queue = name
                ORDER BY COALESCE(waiting_jobs, 0) DESC, name LIMIT 20""",
        steps=f"SELECT queue, unnest(generate_series({start}, date_trunc('{grain}', {now}), INTERVAL 1 {grain})) AS step FROM page",
        points=f"""SELECT queue, date_trunc('{grain}', created_at) AS step,
                     COUNT(*) FILTER (WHERE status = 'completed') AS completed,
                     COUNT(*) FILTER (WHERE status = 'failed') AS failed
                   FROM runs WHERE created_at >= {start} AND created_at < {now} GROUP BY 1, 2""",
    )


def _chart(spark, sf, days):
    runs = fx.job_runs(spark, sf)
    page = q.queues_page(fx.queues(spark, sf), runs, fx.schedulers(spark, sf)).rows
    return q.queue_chart(page, _rollup(spark, sf), runs, datetime(2024, 1, 30, 20, 40), days)


@query(_chart_check("hour", 7))
def queue_chart(spark, sf):
    return _chart(spark, sf, 7)


@query(_chart_check("day", 15))
def queue_chart_daily(spark, sf):
    return _chart(spark, sf, 15)


_STATS = """
  SELECT COUNT(*) AS total_queues, COUNT(*) FILTER (WHERE NOT is_paused) AS active_queues,
    COUNT(s.queue_id) AS queues_with_schedulers
  FROM queues LEFT JOIN (SELECT DISTINCT queue_id FROM schedulers) s ON s.queue_id = id"""


@query(check(_STATS))
def queue_stats(spark, sf):
    return q.queue_stats(fx.queues(spark, sf), fx.schedulers(spark, sf))


@query(check("""
  SELECT (SELECT COUNT(*) FROM runs WHERE status = 'active') AS active_jobs,
    (SELECT COUNT(*) FROM runs WHERE status = 'waiting') AS waiting_jobs, stats.* FROM stats""", stats=_STATS))
def system_overview(spark, sf):
    return q.system_overview(fx.job_runs(spark, sf), fx.queues(spark, sf), fx.schedulers(spark, sf))


@query(check(f"""
  SELECT COUNT(*) FILTER (WHERE status = 'active') AS active,
    COUNT(*) FILTER (WHERE status = 'failed' AND created_at BETWEEN {AS_OF} - INTERVAL 10 DAY AND {AS_OF}) AS failed,
    COUNT(*) FILTER (WHERE status = 'completed' AND created_at BETWEEN {AS_OF} - INTERVAL 10 DAY AND {AS_OF}) AS completed
  FROM runs"""))
def job_stats(spark, sf):
    return q.job_stats(fx.job_runs(spark, sf), fx.AS_OF, 10)


_LAST = """SELECT DISTINCT ON (queue) * FROM runs ORDER BY queue, created_at DESC, job_id DESC, id DESC"""


@query(check("SELECT q.id AS queue_id, l.status FROM queues q JOIN last l ON l.queue = q.name", last=_LAST))
def last_status_per_queue(spark, sf):
    return q.last_status(fx.queues(spark, sf), fx.job_runs(spark, sf))


@query(check("SELECT queue, data, name AS job_name FROM last", last=_LAST))
def last_run_data(spark, sf):
    return q.last_run_data(fx.job_runs(spark, sf))


@query(check("SELECT DISTINCT queue FROM runs"))
def distinct_queues(spark, sf):
    return q.queue_names(fx.job_runs(spark, sf))
