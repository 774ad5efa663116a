"""Queries over job runs, log lines and tags."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from runloom.functions.text import strip_ansi, tags_text as tags_as_text
from runloom.functions.time import created_boundary_column, epoch_ms
from runloom.operators import logs as lg, search as js, tags as tg, trigrams
from runloom.plans import fixture as fx
from runloom.plans.checks import AS_OF, check
from runloom.plans.registry import query
from runloom.session import shared_dir
from runloom.sources import tables

_MIDDLE = datetime(2024, 1, 15, 12)
_LIST = """id, job_id, queue, name, status, attempt, max_attempts, created_at, enqueued_at, started_at, finished_at,
    duration_ms, error_message, array_to_string(tags, ',') AS tags"""


def _flat(runs: DataFrame) -> DataFrame:
    return runs.withColumn("tags", F.array_join("tags", ","))


def _listed(runs: DataFrame) -> DataFrame:
    return _flat(runs.select(*js.RUN_LIST_COLUMNS))


def _page_check(where: str, order: str, limit: int, reverse: bool = False) -> str:
    position = "COUNT(*) OVER () - n + 1" if reverse else "n"
    return check(
        f"SELECT {_LIST}, CAST({position} AS INTEGER) AS position FROM scan",
        scan=f"SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM runs WHERE {where} ORDER BY {order} LIMIT {limit}",
    )


_AT = "TIMESTAMP '2024-01-15 12:00:00'"
_CURSOR = js.JobCursor(created_at=epoch_ms(_MIDDLE), job_id="", id="", duration_ms=20_000)


@query(_page_check(f"(created_at, job_id, id) < ({_AT}, '', '')", "created_at DESC, job_id DESC, id DESC", 20))
def jobs_page_created_next(spark, sf):
    return _flat(js.jobs_page(fx.job_runs(spark, sf), _CURSOR).rows)


@query(_page_check(f"(created_at, job_id, id) > ({_AT}, '', '')", "created_at, job_id, id", 20, reverse=True))
def jobs_page_created_prev(spark, sf):
    return _flat(js.jobs_page(fx.job_runs(spark, sf), _CURSOR, cursor_direction="prev").rows)


@query(_page_check(f"(COALESCE(duration_ms, 0), created_at, job_id, id) < (20000, {_AT}, '', '')",
                   "COALESCE(duration_ms, 0) DESC, created_at DESC, job_id DESC, id DESC", 50))
def jobs_page_duration(spark, sf):
    return _flat(js.jobs_page(fx.job_runs(spark, sf), _CURSOR, sort_by="duration_ms", limit=50).rows)


@query(check("""
  SELECT epoch_ms(b.created_at) AS next_created_at, b.job_id AS next_job_id, b.id AS next_id,
    b.duration_ms AS next_duration_ms, epoch_ms(a.created_at) AS prev_created_at, a.job_id AS prev_job_id,
    a.id AS prev_id, a.duration_ms AS prev_duration_ms
  FROM scan a JOIN scan b ON a.n = 1 AND b.n = 20""",
             scan=f"""SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id DESC, id DESC) AS n FROM runs
                      WHERE (created_at, job_id, id) < ({_AT}, '', '')"""))
def jobs_page_cursors(spark, sf):
    return js.jobs_page(fx.job_runs(spark, sf), _CURSOR).cursors


@query(check(f"""
  SELECT {_LIST} FROM runs WHERE queue = 'q3' AND status = 'failed'
    AND created_at >= TIMESTAMP '2024-01-03 00:00:00'"""))
def jobs_filtered(spark, sf):
    return _listed(js.filter_runs(fx.job_runs(spark, sf), queue="q3", status="failed", created_from="2024-01-03"))


@query(check(f"SELECT {_LIST} FROM runs"))
def jobs_unfiltered(spark, sf):
    """``all`` and an unknown status filter nothing."""
    return _listed(js.filter_runs(fx.job_runs(spark, sf), queue="all", status="no-such-status", tags=[]))


@query(check(f"""
  SELECT {_LIST} FROM runs WHERE name ILIKE '%Oom 1%' OR queue ILIKE '%Oom 1%' OR job_id ILIKE '%Oom 1%'
    OR error_message ILIKE '%Oom 1%'"""))
def jobs_search_text(spark, sf):
    return _listed(js.filter_runs(fx.job_runs(spark, sf), search="Oom 1"))


@query(check(f"""
  SELECT {_LIST} FROM runs WHERE name ILIKE '%b__m%3%' OR queue ILIKE '%b__m%3%' OR job_id ILIKE '%b__m%3%'
    OR error_message ILIKE '%b__m%3%'"""))
def jobs_search_wildcards(spark, sf):
    return _listed(js.filter_runs(fx.job_runs(spark, sf), search="b__m%3"))


_DETAIL = """id, job_id, queue, name, status, attempt, max_attempts, priority, delay_ms, backoff, repeat_job_key,
    parent_job_id, worker_id, array_to_string(tags, ',') AS tags, data, result, error_message, error_stack,
    epoch_ms(created_at) AS created_at, epoch_ms(enqueued_at) AS enqueued_at, epoch_ms(started_at) AS started_at,
    epoch_ms(finished_at) AS finished_at, duration_ms"""


def _stored_runs(spark, sf) -> str:
    path = shared_dir(spark, "runs")
    tables.write_runs(fx.job_runs(spark, sf), path, versioned=True)
    return path


_TEXTS = ["name", "queue", "job_id", "error_message"]


@query(check(f"""
  SELECT {_LIST} FROM runs WHERE name ILIKE '%Oom 12%' OR queue ILIKE '%Oom 12%' OR job_id ILIKE '%Oom 12%'
    OR error_message ILIKE '%Oom 12%'"""))
def jobs_search_indexed(spark, sf):
    """Text search that opens only the files which have all trigrams of the text."""
    path, index = _stored_runs(spark, sf), shared_dir(spark, "trigrams")
    trigrams.write_postings(tables.read_table(spark, path), _TEXTS, index)
    return _listed(trigrams.search(spark, path, index, _TEXTS, "Oom 12"))


@query(check("SELECT id, level, message FROM logs WHERE message ILIKE '%job 77% failed%'"))
def logs_search_indexed(spark, sf):
    """Log search over an index that lags: one half of the lines was written after it."""
    path, index = shared_dir(spark, "logs"), shared_dir(spark, "trigrams")
    logs = fx.job_logs(spark, sf)
    early = F.dayofmonth("ts") <= 15
    tables.write_logs(logs.filter(early), path, versioned=True)
    trigrams.write_postings(tables.read_table(spark, path), ["message"], index)
    tables.write_logs(logs.filter(~early), path)
    return trigrams.search(spark, path, index, ["message"], "job 77% failed").select("id", "level", "message")


@query(_page_check("true", "created_at DESC, job_id DESC, id DESC", 50))
def jobs_page_stored(spark, sf):
    """The first page of a stored table, looked for in its newest dates."""
    path = _stored_runs(spark, sf)
    page = js.stored_page(tables.read_table(spark, path), tables.dates_of(spark, path, "created_date"), limit=50)
    return _flat(page.drop("next_cursor", "prev_cursor"))


@query(_page_check(f"(created_at, job_id, id) > ({_AT}, '', '')", "created_at, job_id, id", 20, reverse=True))
def jobs_page_stored_prev(spark, sf):
    path = _stored_runs(spark, sf)
    stored, dates = tables.read_table(spark, path), tables.dates_of(spark, path, "created_date")
    return _flat(js.stored_page(stored, dates, _CURSOR, cursor_direction="prev").drop("next_cursor", "prev_cursor"))


@query(check(f"SELECT {_DETAIL} FROM runs WHERE job_id = '77'"))
def job_detail_stored(spark, sf):
    """One run of a stored table, found by its id and creation time."""
    stored = tables.read_table(spark, _stored_runs(spark, sf))
    wanted = fx.job_runs(spark, sf).filter("job_id = '77'").select("id", "created_at")
    return _flat(js.job_detail(stored, wanted))


@query(check("""
  SELECT id, job_run_id, level, message, epoch_ms(ts) AS ts, log_seq, CAST(n AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (ORDER BY ts, log_seq, id) AS n FROM one) WHERE n > 300 AND n <= 400""",
             one="SELECT l.id, 'all' AS job_run_id, level, message, l.ts, log_seq FROM logs l"))
def logs_deep_offset(spark, sf):
    """A page deep in the log of a run that never ends, looked up in the counts per hour."""
    path = shared_dir(spark, "logs")
    tables.write_logs(fx.job_logs(spark, sf).withColumn("job_run_id", F.lit("all")), path, versioned=True)
    stored = tables.read_table(spark, path)
    return lg.stored_logs_page(stored, lg.line_counts(stored), "all", limit=100, offset=300)


@query(check(f"SELECT {_LIST} FROM runs WHERE list_has_any(tags, ['signup', 'seg3'])"))
def jobs_by_tags(spark, sf):
    return _listed(js.filter_runs(fx.job_runs(spark, sf), tags=["signup", "seg3"]))


@query(check(f"""
  SELECT {_LIST} FROM runs
  WHERE created_at BETWEEN TIMESTAMP '2024-01-05 22:00:00' AND TIMESTAMP '2024-01-10 12:30:59.999'"""))
def jobs_created_range(spark, sf):
    return _listed(js.filter_runs(fx.job_runs(spark, sf), created_from="2024-01-06T00:00+02:00",
                                  created_to="2024-01-10T12:30"))


@query(check(f"SELECT {_DETAIL} FROM runs WHERE status = 'failed'"))
def job_detail(spark, sf):
    runs = fx.job_runs(spark, sf)
    return _flat(js.job_detail(runs, runs.filter("status = 'failed'")))


@query(check("SELECT id, queue, job_id, enqueued_at FROM runs WHERE priority IS NOT NULL"))
def jobs_by_key(spark, sf):
    runs = fx.job_runs(spark, sf)
    keys = fx.jobs(spark, sf).filter("priority is not null").select("queue", "job_id", "enqueued_at")
    return js.jobs_by_key(runs, keys)


@query(check("""
  SELECT job_id, date_trunc('day', created_at) AS day_start,
    date_trunc('day', created_at) + INTERVAL 1 DAY - to_milliseconds(1) AS day_end,
    date_trunc('minute', created_at) + to_milliseconds(59999) AS minute_end,
    date_trunc('second', created_at) - INTERVAL 90 MINUTE AS zoned
  FROM runs"""))
def created_boundaries(spark, sf):
    """Range ends read from texts of every accepted form."""
    moment = F.col("created_at")
    texts = fx.job_runs(spark, sf).select(
        "job_id",
        F.date_format(moment, "yyyy-MM-dd").alias("day"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm").alias("minute"),
        F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0130")).alias("zoned"),
    )
    return texts.select(
        "job_id",
        created_boundary_column(F.col("day")).alias("day_start"),
        created_boundary_column(F.col("day"), upper=True).alias("day_end"),
        created_boundary_column(F.col("minute"), upper=True).alias("minute_end"),
        created_boundary_column(F.col("zoned")).alias("zoned"),
    )


# Log lines.

_ERRORS = "level = 'error' AND message ILIKE '%9 FAILED%'"


@query(check(f"""
  SELECT id, job_run_id, level, message, epoch_ms(ts) AS ts, log_seq, CAST(n AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (ORDER BY ts, log_seq, id) AS n FROM logs WHERE {_ERRORS})
  WHERE n > 3 AND n <= 103"""))
def job_logs_page(spark, sf):
    hits = lg.filter_logs(fx.job_logs(spark, sf), level="error", message_contains="9 FAILED")
    return lg.logs_page(hits, limit=100, offset=3)


@query(check(f"SELECT COUNT(*) AS total FROM logs WHERE {_ERRORS}"))
def job_logs_total(spark, sf):
    return lg.logs_total(lg.filter_logs(fx.job_logs(spark, sf), level="error", message_contains="9 FAILED"))


@query(check("SELECT id, job_run_id, level, message, ts, log_seq FROM twice WHERE n = 1", twice="""
  SELECT *, row_number() OVER (PARTITION BY job_run_id, ts, log_seq ORDER BY id) AS n FROM (
    SELECT id, job_run_id, level, message, ts, log_seq FROM logs
    UNION ALL SELECT reverse(id), job_run_id, level, message || ' again', ts, log_seq FROM logs WHERE level = 'log')"""))
def logs_dedupe(spark, sf):
    logs = fx.job_logs(spark, sf)
    again = logs.filter("level = 'log'").withColumns({
        "id": F.reverse("id"), "message": F.concat("message", F.lit(" again"))
    })
    return lg.drop_duplicates(logs.unionByName(again))


@query(check("SELECT id, message FROM logs"))
def logs_clean_ansi(spark, sf):
    """Lines coloured in several ways come out as they were."""
    esc = lambda code: F.lit(f"\x1b{code}")
    text = F.col("message")
    first, rest = F.substring(text, 1, 3), F.substring(text, F.lit(4), F.length(text))
    coloured = F.concat(esc("[1;31m"), first, esc("[0m"), rest, esc("[K"), esc("M"))
    return fx.job_logs(spark, sf).select("id", strip_ansi(coloured).alias("message"))


@query(check("""
  SELECT queue, user_id AS job_id, day AS log_timestamp, event_id,
    CAST(row_number() OVER (PARTITION BY queue, user_id, day ORDER BY event_id) - 1 AS INTEGER) AS log_seq
  FROM (SELECT *, date_trunc('day', created_at) AS day FROM jobs)"""))
def logs_sequence(spark, sf):
    """Lines of one user and day take the place of lines within one millisecond."""
    lines = fx.jobs(spark, sf).select(
        "queue", F.col("user_id").alias("job_id"), F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("log_timestamp"),
        "event_id",
    )
    return lg.number_lines(lines, order="event_id", block=256)


@query(check(f"""
  SELECT id, job_run_id, level, start_ms, end_ms, epoch_ms(ts) - start_ms AS relative_ms,
    CASE WHEN end_ms > start_ms THEN CAST(epoch_ms(ts) - start_ms AS DOUBLE) / (end_ms - start_ms) * 100 ELSE 0 END
      AS position_pct
  FROM (SELECT l.id, l.job_run_id, l.level, l.ts, epoch_ms(r.enqueued_at) + r.delay_ms AS start_ms,
          COALESCE(epoch_ms(r.finished_at), epoch_ms({AS_OF})) AS end_ms
        FROM logs l JOIN runs r ON r.id = l.job_run_id)"""))
def log_timeline(spark, sf):
    return lg.timeline(fx.job_logs(spark, sf), fx.job_runs(spark, sf), fx.AS_OF)


# Tags.

_CATALOGUE = f"""
  SELECT tag, lower(tag) AS tag_lower, MAX(created_at) AS last_seen_at, {AS_OF} AS updated_at
  FROM (SELECT unnest(tags) AS tag, created_at FROM runs) WHERE tag <> '' GROUP BY tag"""


@query(check(_CATALOGUE))
def tag_catalogue(spark, sf):
    return tg.tag_catalogue(fx.job_runs(spark, sf), fx.AS_OF)


@query(check(f"""
  SELECT tag, lower(tag) AS tag_lower, MAX(seen) AS last_seen_at, MAX(stamp) AS updated_at FROM (
    SELECT unnest(tags) AS tag, created_at - INTERVAL 1 DAY AS seen, {AS_OF} - INTERVAL 1 DAY AS stamp
      FROM runs WHERE event_type <> 'signup'
    UNION ALL SELECT unnest(tags), created_at, {AS_OF} FROM runs WHERE created_at >= {AS_OF} - INTERVAL 1 HOUR)
  GROUP BY tag""".replace("event_type", "name")))
def tag_upsert(spark, sf):
    """An older catalogue meets the tags of the last hour."""
    runs = fx.job_runs(spark, sf)
    older = runs.filter("name <> 'signup'").withColumn("created_at", F.expr("created_at - interval 1 day"))
    stored = tg.tag_catalogue(older, datetime(2024, 1, 30))
    return tg.upsert_tags(stored, tg.recent_tags(runs, fx.AS_OF))


def _search_check(pattern: str, prefix: str) -> str:
    return check(f"""
      SELECT tag, CASE WHEN tag_lower LIKE '{prefix}' THEN 0 ELSE 1 END AS rank FROM catalogue
      WHERE tag_lower LIKE '{pattern}' ORDER BY 2, tag LIMIT 100""", catalogue=_CATALOGUE)


@query(_search_check("se%", "se%"))
def tag_search_prefix(spark, sf):
    return tg.search_tags(tg.tag_catalogue(fx.job_runs(spark, sf), fx.AS_OF), "  SE ")


@query(_search_check("%ign%", "ign%"))
def tag_search_contains(spark, sf):
    return tg.search_tags(tg.tag_catalogue(fx.job_runs(spark, sf), fx.AS_OF), "ign")


@query(check("SELECT id, array_to_string(tags, ' ') AS tags_text FROM runs"))
def tags_text(spark, sf):
    return fx.job_runs(spark, sf).select("id", tags_as_text(F.col("tags")).alias("tags_text"))
