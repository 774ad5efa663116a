"""Searching and paging job runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from runloom.functions.text import contains_ci, is_uuid
from runloom.functions.time import created_boundary, instant, to_epoch_ms, ts
from runloom.operators.paging import Page, check_choice, check_limit, cut_page, flipped, ordered
from runloom.operators.pruning import created_between, of_dates
from runloom.schemas import JOB_RUNS, JOB_STATUSES, RUN_KEY, RUN_LIST_COLUMNS


@dataclass(frozen=True)
class JobCursor:
    """Place in the job list, with the creation time in epoch milliseconds."""

    created_at: int
    job_id: str
    id: str
    duration_ms: int | None = None


def search_text(runs: DataFrame, text: str) -> DataFrame:
    """Runs whose name, queue, job id or error contains the text, or whose id it is."""
    hits = [contains_ci(F.col(c), text) for c in ("name", "queue", "job_id", "error_message")]
    if is_uuid(text):
        hits.append(F.col("id") == text.lower())
    return runs.filter(reduce(lambda a, b: a | b, hits))


def with_any_tag(runs: DataFrame, tags: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(t) for t in tags])
    return runs.filter(F.coalesce(F.arrays_overlap("tags", wanted), F.lit(False)))


def filter_runs(
    runs: DataFrame,
    search: str | None = None,
    queue: str | None = None,
    status: str | None = None,
    tags: list[str] | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
) -> DataFrame:
    """The filters of the job list; ``all`` and unknown statuses filter nothing."""
    start = created_boundary(created_from) if created_from else None
    end = created_boundary(created_to, upper=True) if created_to else None
    runs = created_between(runs, start, end, inclusive_end=True)
    if queue and queue != "all":
        runs = runs.filter(F.col("queue") == queue)
    if status in JOB_STATUSES:
        runs = runs.filter(F.col("status") == status)
    if tags:
        runs = with_any_tag(runs, tags)
    return search_text(runs, search) if search else runs


def _beyond(keys: list[tuple[Column, Column]], smaller: bool) -> Column:
    """Row comparison key by key, all in one direction."""
    column, value = keys[0]
    past = column < value if smaller else column > value
    if len(keys) == 1:
        return past
    return past | ((column == value) & _beyond(keys[1:], smaller))


def after_cursor(runs: DataFrame, cursor: JobCursor, direction: str, sort_by: str, sort_direction: str) -> DataFrame:
    smaller = flipped(sort_direction, direction) == "desc"
    moment = instant(cursor.created_at)
    keys = [
        (F.col("created_at"), ts(moment)),
        (F.col("job_id"), F.lit(cursor.job_id)),
        (F.col("id"), F.lit(cursor.id)),
    ]
    if sort_by == "duration_ms":
        keys.insert(0, (F.coalesce("duration_ms", F.lit(0)), F.lit(cursor.duration_ms or 0)))
    elif smaller:
        # Implied by the comparison, and reaches the scan and its partitions.
        runs = created_between(runs, None, moment, inclusive_end=True)
    else:
        runs = created_between(runs, moment, None)
    return runs.filter(_beyond(keys, smaller))


def jobs_page(
    runs: DataFrame,
    cursor: JobCursor | None = None,
    cursor_direction: str = "next",
    sort_by: str = "created_at",
    sort_direction: str = "desc",
    limit: int = 20,
) -> Page:
    """One page of the (already filtered) job list and the cursors around it."""
    check_limit(limit)
    check_choice("sort_by", sort_by, ["created_at", "duration_ms"])
    check_choice("sort_direction", sort_direction, ["asc", "desc"])
    check_choice("cursor_direction", cursor_direction, ["next", "prev"])
    if cursor is not None:
        runs = after_cursor(runs, cursor, cursor_direction, sort_by, sort_direction)
    direction = flipped(sort_direction, cursor_direction)
    keys = [F.col("created_at"), F.col("job_id"), F.col("id")]
    if sort_by == "duration_ms":
        keys.insert(0, F.coalesce("duration_ms", F.lit(0)))
    fields = {
        "created_at": to_epoch_ms(F.col("created_at")),
        "job_id": F.col("job_id"),
        "id": F.col("id"),
        "duration_ms": F.col("duration_ms"),
    }
    order = [ordered(k, direction) for k in keys]
    return cut_page(runs.select(*RUN_LIST_COLUMNS), order, limit, cursor_direction, cursor is not None, fields)


def stored_page(
    runs: DataFrame,
    dates: list[str],
    cursor: JobCursor | None = None,
    cursor_direction: str = "next",
    sort_direction: str = "desc",
    limit: int = 20,
) -> DataFrame:
    """One page by creation time of a table stored by date: the rows, their position and the cursors on each row.

    ``dates`` are the partitions the table has. The page is looked for in the
    date that the order begins with, then in two, four and so on, until it is
    full: a page of a busy table reads one date, whatever the table holds. At
    most ``limit`` + 1 rows come to the driver each time, and rows and cursors
    come from the same scan.
    """
    check_limit(limit)
    direction = flipped(sort_direction, cursor_direction)
    left = sorted(dates, reverse=direction == "desc")
    if cursor is not None:
        day = instant(cursor.created_at).date().isoformat()
        left = [d for d in left if (d <= day if direction == "desc" else d >= day)]
    order = [ordered(F.col(c), direction) for c in ("created_at", "job_id", "id")]
    found, take = [], 1
    rows = runs if cursor is None else after_cursor(runs, cursor, cursor_direction, "created_at", sort_direction)
    while left and len(found) <= limit:
        some, left, take = left[:take], left[take:], 2 * take
        low, high = (F.lit(date.fromisoformat(d)) for d in (min(some), max(some)))
        part = rows.filter(F.col("created_date").between(low, high)).select(*RUN_LIST_COLUMNS)
        # Dates come in the order of the page, so what they add goes behind what is there.
        found += part.orderBy(*order).limit(limit + 1 - len(found)).collect()
    more, found = len(found) > limit, found[:limit]
    if cursor_direction == "prev":
        found.reverse()
    after, before = (cursor is not None, more) if cursor_direction == "prev" else (more, cursor is not None)
    spark = runs.sparkSession
    page = spark.createDataFrame(
        [(*r, k + 1) for k, r in enumerate(found)], runs.select(*RUN_LIST_COLUMNS, F.lit(0).alias("position")).schema)
    fields = [to_epoch_ms(F.col("created_at")).alias("created_at"), "job_id", "id", "duration_ms"]
    ends = F.struct(*fields)
    at = lambda k: F.max(F.when(F.col("position") == k, ends)).over(Window.partitionBy())
    return page.withColumns({
        "next_cursor": at(len(found)) if after else F.lit(None).cast(page.select(ends.alias("c")).schema["c"].dataType),
        "prev_cursor": at(1) if before else F.lit(None).cast(page.select(ends.alias("c")).schema["c"].dataType),
    })


def job_detail(runs: DataFrame, ids: DataFrame | str, created_at: datetime | None = None) -> DataFrame:
    """All fields of one run, or of many given as a frame with an ``id`` column.

    Instants are epoch milliseconds. Callers who know when a run was created
    (the list shows it) say so, by ``created_at`` or by a column of that name
    beside the ids: then only that date is opened, and in it, by the Bloom
    filters of a stored table, only the row groups that may hold the id.
    """
    if isinstance(ids, str):
        found = runs.filter(F.col("id") == ids)
        if created_at is not None:
            found = created_between(found, created_at, created_at, inclusive_end=True)
    else:
        if "created_at" in ids.columns:
            runs = of_dates(runs, ids, "created_at")
        found = runs.join(ids.select("id"), "id", "left_semi")
    moments = ["created_at", "enqueued_at", "started_at", "finished_at"]
    return found.select(*JOB_RUNS.names).withColumns({c: to_epoch_ms(F.col(c)) for c in moments})


def jobs_by_key(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of runs given by (queue, job_id), and enqueued_at where the keys have it."""
    on = [c for c in RUN_KEY if c in keys.columns]
    if "enqueued_at" in on:
        # The creation time is part of the key, so only its dates can hold the run.
        runs = of_dates(runs, keys, "enqueued_at")
    return runs.select("id", *RUN_KEY).join(keys.select(*on).distinct(), on, "left_semi")


