"""Queue lists, charts and counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from runloom.functions.text import contains_ci, drop_blank, drop_zero
from runloom.functions.time import DAY, dashboard_window, floor_to, label, naive_utc, trunc, ts
from runloom.operators.dashboard import calendar, pressure_per_queue
from runloom.operators.paging import MAX_LIMIT, Page, check_choice, check_limit, cut_page, flipped, ordered
from runloom.operators.pruning import created_between

METRICS = ["waiting_jobs", "active_jobs", "pressure"]


@dataclass(frozen=True)
class QueueCursor:
    name: str
    waiting_jobs: int = 0
    active_jobs: int = 0
    pressure: int | None = None


def live_counts(runs: DataFrame) -> DataFrame:
    """Waiting and active runs per queue, in one pass."""
    live = runs.filter(F.col("status").isin("waiting", "active"))
    return live.groupBy("queue").agg(
        F.count_if(F.col("status") == "waiting").alias("waiting_jobs"),
        F.count_if(F.col("status") == "active").alias("active_jobs"),
    )


def search_queues(queues: DataFrame, search: str | None) -> DataFrame:
    return queues.filter(contains_ci(F.col("name"), search)) if search else queues


def queue_total(queues: DataFrame, search: str | None = None) -> DataFrame:
    """Number of matching queues: the search counts, the cursor does not."""
    return search_queues(queues, search).agg(F.count(F.lit(1)).alias("total"))


def scheduler_lists(schedulers: DataFrame) -> DataFrame:
    """Patterns and intervals of the schedulers of each queue, sorted, blanks dropped."""
    return schedulers.groupBy("queue_id").agg(
        F.array_sort(drop_blank(F.array_agg("pattern"))).alias("patterns"),
        F.array_sort(drop_zero(F.array_agg("every"))).alias("everys"),
    )


def _after_cursor(cursor: QueueCursor, metric: str, direction: str, sort_direction: str) -> Column:
    value = getattr(cursor, metric)
    if value is None:
        raise ValueError("a pressure cursor is needed when sorting by pressure")
    column, name = F.col(metric), F.col("name")
    # The name runs forward on the way there and backward on the way back,
    # whatever the direction of the metric.
    tie = (column == value) & (name > cursor.name if direction == "next" else name < cursor.name)
    rising = flipped(sort_direction, direction) == "asc"
    return tie | (column > value if rising else column < value)


def queues_page(
    queues: DataFrame,
    runs: DataFrame,
    schedulers: DataFrame,
    rollup: DataFrame | None = None,
    search: str | None = None,
    cursor: QueueCursor | None = None,
    cursor_direction: str = "next",
    sort_by: str = "waiting_jobs",
    sort_direction: str = "desc",
    pressure_from: datetime | None = None,
    pressure_to: datetime | None = None,
    limit: int = 20,
) -> Page:
    """One page of queues by a live count or by pressure.

    Runs and hours are reduced to one row per queue before they meet the queue
    table, and the schedulers of each queue join the finished page, so the runs
    are read once. Pressure is zero unless it is the sort key.
    """
    check_limit(limit)
    check_choice("sort_by", sort_by, METRICS)
    check_choice("sort_direction", sort_direction, ["asc", "desc"])
    check_choice("cursor_direction", cursor_direction, ["next", "prev"])
    shown = search_queues(queues, search).select("id", "name", "is_paused")
    counts = live_counts(runs).withColumnRenamed("queue", "name")
    rows = shown.join(counts, "name", "left")
    if sort_by == "pressure":
        if rollup is None or pressure_from is None or pressure_to is None:
            raise ValueError("sorting by pressure needs the rollup and both ends of its range")
        if pressure_from >= pressure_to:
            raise ValueError("the pressure range must not be empty")
        weights = pressure_per_queue(rollup, pressure_from, pressure_to).withColumnRenamed("queue", "name")
        rows = rows.join(weights, "name", "left")
    else:
        rows = rows.withColumn("pressure", F.lit(0))
    rows = rows.withColumns({m: F.coalesce(m, F.lit(0)).cast("long") for m in METRICS})
    if cursor is not None:
        rows = rows.filter(_after_cursor(cursor, sort_by, cursor_direction, sort_direction))
    order = [
        ordered(F.col(sort_by), flipped(sort_direction, cursor_direction)),
        ordered(F.col("name"), "asc" if cursor_direction == "next" else "desc"),
    ]
    fields = {name: F.col(name) for name in ["name", *METRICS]}
    page = cut_page(rows, order, limit, cursor_direction, cursor is not None, fields)
    lists = scheduler_lists(schedulers).withColumnRenamed("queue_id", "id")
    full = page.rows.join(lists, "id", "left").select(
        "name", "is_paused",
        F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"),
        F.coalesce("everys", F.array().cast("array<int>")).alias("everys"),
        *METRICS, "position",
    )
    return Page(full, page.cursors)


def agent_view(page_rows: DataFrame) -> DataFrame:
    """The list as agents get it: without pressure."""
    return page_rows.drop("pressure")


def queue_names_page(queues: DataFrame, cursor: str | None = None, search: str | None = None, limit: int = 20) -> Page:
    """Queue names from the cursor on, with the starts of the next and previous pages."""
    check_limit(limit)
    names = search_queues(queues, search).select("id", "name")
    ahead = names.filter(F.col("name") >= cursor) if cursor else names
    ahead = ahead.orderBy("name").limit(limit + 1)
    forward = ahead.withColumn("position", F.row_number().over(Window.orderBy("name")))
    next_start = forward.filter(F.col("position") == limit + 1).agg(F.max("name").alias("next_cursor"))
    if cursor:
        # One row more than a page before the cursor, the page before starts at
        # the last but one of them.
        behind = names.filter(F.col("name") < cursor).orderBy(F.col("name").desc()).limit(limit + 1)
        numbered = behind.withColumn("_no", F.row_number().over(Window.orderBy(F.col("name").desc())))
        back = numbered.agg(
            F.when(F.max("_no") > limit, F.max(F.when(F.col("_no") == limit, F.col("name")))).alias("prev_cursor")
        )
    else:
        back = next_start.select(F.lit(None).cast("string").alias("prev_cursor"))
    cursors = next_start.unionByName(back, allowMissingColumns=True).agg(
        F.max("next_cursor").alias("next_cursor"), F.max("prev_cursor").alias("prev_cursor")
    )
    return Page(forward.filter(F.col("position") <= limit), cursors)


def queue_chart(names: list[str] | DataFrame, rollup: DataFrame, runs: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Completed and failed runs per step for the queues of a page.

    Closed hours come from the rollup, the current hour from the runs; the two
    are added up, and steps without runs show zero. Names in a list reach both
    scans as values; a page of queues, as a frame with their ``name``, is joined
    as it comes, without running it first.
    """
    if isinstance(names, DataFrame):
        # A page has MAX_LIMIT rows at most.
        pages = names.select(F.col("name").alias("queue")).limit(MAX_LIMIT)
        on_page = lambda rows: rows.join(F.broadcast(pages), "queue", "left_semi")
    else:
        check_limit(max(len(names), 1))
        pages = rollup.sparkSession.createDataFrame([(name,) for name in names], "queue string")
        on_page = lambda rows: rows.filter(F.col("queue").isin(names))
    window = dashboard_window(as_of, days)
    this_hour = floor_to("hour", as_of)
    hours = rollup.filter((F.col("bucket_start") >= ts(window.start)) & (F.col("bucket_start") < ts(this_hour)))
    past = on_page(hours).select(
        "queue", trunc(window.grain, F.col("bucket_start")).alias("_step"),
        F.col("completed_runs").alias("completed"), F.col("failed_runs").alias("failed"),
    )
    fresh = created_between(runs, this_hour, naive_utc(as_of)).filter(F.col("status").isin("completed", "failed"))
    now = on_page(fresh).select(
        "queue", trunc(window.grain, F.col("created_at")).alias("_step"),
        (F.col("status") == "completed").cast("long").alias("completed"),
        (F.col("status") == "failed").cast("long").alias("failed"),
    )
    points = past.unionByName(now).groupBy("queue", "_step").agg(
        F.sum("completed").alias("completed"), F.sum("failed").alias("failed")
    )
    steps = calendar(pages, window.start, window.end, window.step, "_step")
    return steps.join(points, ["queue", "_step"], "left").select(
        "queue", label(F.col("_step")).alias("timestamp"),
        F.coalesce("completed", F.lit(0)).cast("long").alias("completed"),
        F.coalesce("failed", F.lit(0)).cast("long").alias("failed"),
    )


def page_with_stats(page_rows: DataFrame, rollup: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Fill in the pressure of the queues of a page."""
    weights = pressure_per_queue(rollup, start, end).select(F.col("queue").alias("name"), F.col("pressure").alias("_p"))
    return page_rows.join(weights, "name", "left").withColumn("pressure", F.coalesce("_p", F.lit(0))).drop("_p")


def queue_stats(queues: DataFrame, schedulers: DataFrame) -> DataFrame:
    """Number of queues, of running ones and of those with a scheduler."""
    scheduled = schedulers.select(F.col("queue_id").alias("id"), F.lit(True).alias("_scheduled")).distinct()
    return queues.select("id", "is_paused").join(scheduled, "id", "left").agg(
        F.count(F.lit(1)).alias("total_queues"),
        F.count_if(~F.col("is_paused")).alias("active_queues"),
        F.count("_scheduled").alias("queues_with_schedulers"),
    )


def system_overview(runs: DataFrame, queues: DataFrame, schedulers: DataFrame) -> DataFrame:
    """The queue numbers together with the live runs; of the others none is read beyond its status."""
    live = runs.filter(F.col("status").isin("active", "waiting")).agg(
        F.count_if(F.col("status") == "active").alias("active_jobs"),
        F.count_if(F.col("status") == "waiting").alias("waiting_jobs"),
    )
    both = live.unionByName(queue_stats(queues, schedulers), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def job_stats(runs: DataFrame, as_of: datetime, days: int = 1) -> DataFrame:
    """Runs active now, and failed and completed ones of the last days."""
    if not 1 <= days <= 30:
        raise ValueError("days must lie between 1 and 30")
    end = naive_utc(as_of)
    recent = F.col("created_at").between(ts(end - days * DAY), ts(end))
    finished = F.col("status").isin("failed", "completed") & recent
    # The two kinds of runs it counts, told to the scan.
    return runs.filter((F.col("status") == "active") | finished).agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if((F.col("status") == "failed") & recent).alias("failed"),
        F.count_if((F.col("status") == "completed") & recent).alias("completed"),
    )


def _latest(runs: DataFrame, *values: str) -> DataFrame:
    """Values of the latest run of each queue, in two steps.

    The newest instants come from a hash aggregate over two narrow columns; only
    the runs at those instants, of their dates if the table is stored by date,
    have their values read and their ties broken.
    """
    newest = runs.groupBy("queue").agg(F.max("created_at").alias("_newest"))
    newest = newest.select(F.col("queue").alias("_queue"), "_newest", F.to_date("_newest").alias("_date"))
    on = (F.col("queue") == F.col("_queue")) & (F.col("created_at") == F.col("_newest"))
    if "created_date" in runs.columns:
        on = on & (F.col("created_date") == F.col("_date"))
    tied = runs.join(newest, on).select("queue", "job_id", "id", *[c for c in values if c not in ("queue", "job_id", "id")])
    first = Window.partitionBy("queue").orderBy(F.desc("job_id"), F.desc("id"))
    return tied.withColumn("_place", F.row_number().over(first)).filter("_place = 1").select("queue", *values)


def last_status(queues: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of the latest run of each queue that has one."""
    last = _latest(runs, "status").withColumnRenamed("queue", "name")
    return queues.select(F.col("id").alias("queue_id"), "name").join(last, "name").select("queue_id", "status")


def last_run_data(runs: DataFrame) -> DataFrame:
    """Payload and job name of the latest run of each queue."""
    return _latest(runs, "data", "name").withColumnRenamed("name", "job_name")


def queue_names(runs: DataFrame) -> DataFrame:
    return runs.select("queue").distinct()
