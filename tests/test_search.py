from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rows import T0, queues, run, runs, schedulers
from runloom.operators import queues as q, search as js
from runloom.sources import tables

MS = timedelta(milliseconds=1)


@pytest.fixture(scope="module")
def table(spark):
    """Many ties: equal times, equal job ids in two queues, missing durations."""
    rows = []
    for i in range(60):
        moment = T0 + (i % 7) * MS
        rows.append(run(str(i % 20), f"q{i % 3}", created_at=moment, enqueued_at=moment, id=f"{i:03d}",
                        duration_ms=None if i % 4 == 0 else (i % 5) * 10))
    return runs(spark, rows).cache()


def _cursor(row, side):
    if row[f"{side}_id"] is None:
        return None
    return js.JobCursor(row[f"{side}_created_at"], row[f"{side}_job_id"], row[f"{side}_id"], row[f"{side}_duration_ms"])


def _walk(table, limit, **options):
    pages, cursor = [], None
    while True:
        page = js.jobs_page(table, cursor, limit=limit, **options)
        pages.append([r.id for r in page.rows.orderBy("position").collect()])
        cursors = page.cursors.first()
        assert (_cursor(cursors, "prev") is None) == (cursor is None)
        cursor = _cursor(cursors, "next")
        if cursor is None:
            return pages


@pytest.mark.parametrize("sort_by, direction", [("created_at", "desc"), ("duration_ms", "asc")])
def test_pages_concatenate_to_the_full_order(table, sort_by, direction):
    pages = _walk(table, 17, sort_by=sort_by, sort_direction=direction)
    keys = [F.coalesce("duration_ms", F.lit(0))] if sort_by == "duration_ms" else []
    keys += [F.col("created_at"), F.col("job_id"), F.col("id")]
    order = [k.desc() if direction == "desc" else k.asc() for k in keys]
    assert sum(pages, []) == [r.id for r in table.orderBy(*order).collect()]
    assert [len(p) for p in pages] == [17, 17, 17, 9]


def test_going_back_gives_the_page_before(table):
    first = js.jobs_page(table, limit=17)
    second = js.jobs_page(table, _cursor(first.cursors.first(), "next"), limit=17)
    back = js.jobs_page(table, _cursor(second.cursors.first(), "prev"), cursor_direction="prev", limit=17)
    ids = lambda page: [r.id for r in page.rows.orderBy("position").collect()]
    assert ids(back) == ids(first)
    cursors = back.cursors.first()
    assert _cursor(cursors, "prev") is None and _cursor(cursors, "next").id == ids(first)[-1]


def test_empty_page(table):
    page = js.jobs_page(table.filter("false"))
    assert page.rows.count() == 0
    assert set(page.cursors.first()) == {None}


def test_inputs_are_checked(table):
    for bad in ({"limit": 0}, {"limit": 101}, {"sort_by": "name"}, {"sort_direction": "up"}, {"cursor_direction": "x"}):
        with pytest.raises(ValueError):
            js.jobs_page(table, **bad)


def test_tag_overlap_with_nulls(spark):
    rows = runs(spark, [run("1", tags=["a", None]), run("2", tags=[None]), run("3", tags=None), run("4", tags=["b"]), run("5")])
    assert [r.job_id for r in js.filter_runs(rows, tags=["a", "c"]).collect()] == ["1"]


def test_search_wildcards_and_ids(spark):
    uid = "0a0b0c0d-0000-8000-8000-00000000000f"
    rows = runs(spark, [run("1", name="50% off"), run("2", name="500 off"), run("3", error_message="a_b"), run("4", id=uid), run("5", name=None)])
    found = lambda text: sorted(r.job_id for r in js.filter_runs(rows, search=text).collect())
    assert found("50% OFF") == ["1", "2"]
    assert found("50\\% off") == ["1"]
    assert found("a_b") == ["3"]
    assert found(uid.upper()) == ["4"]
    assert found("Q1") == ["1", "2", "3", "4", "5"]


def test_range_ends_are_included(spark):
    ends = [T0.replace(hour=0), T0.replace(hour=23, minute=59, second=59, microsecond=999000)]
    rows = runs(spark, [run(str(i), created_at=t) for i, t in enumerate([ends[0] - MS, *ends, ends[1] + MS])])
    day = str(T0.date())
    assert sorted(r.job_id for r in js.filter_runs(rows, created_from=day, created_to=day).collect()) == ["1", "2"]


def test_keyset_and_range_prune_partitions(spark, folder):
    path = f"{folder}/runs"
    days = [T0 + timedelta(days=i) for i in range(4)]
    tables.write_runs(runs(spark, [run(str(i), created_at=d, enqueued_at=d) for i, d in enumerate(days)]), path)
    stored = tables.read_table(spark, path)
    cursor = js.JobCursor(created_at=1704974400000, job_id="0", id="0")  # the second day, noon
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    page = js.jobs_page(stored, cursor)
    assert "PartitionFilters: [isnotnull(created_date" in plan(page.rows)
    assert "TakeOrderedAndProject" in plan(page.rows)
    assert "data#" not in plan(page.rows).split("ReadSchema")[0].split("FileScan")[1]
    assert [r.job_id for r in page.rows.collect()] == ["0"]
    ranged = js.filter_runs(stored, created_from="2024-01-12")
    assert "PartitionFilters: [isnotnull(created_date" in plan(ranged)
    assert ranged.count() == 2


# Queues.

@pytest.fixture(scope="module")
def board(spark):
    names = [f"q{i}" for i in range(9)] + ["idle"]
    jobs = [run(f"{q}-{i}", f"q{q}", status="waiting" if i < q // 2 else "active") for q in range(9) for i in range(q)]
    plans = schedulers(spark, [
        {"key": "a", "queue_id": "id-q1", "pattern": "z"}, {"key": "b", "queue_id": "id-q1", "pattern": "a", "every": 0},
        {"key": "c", "queue_id": "id-q1", "pattern": "", "every": 7}, {"key": "d", "queue_id": "id-idle", "every": 3},
    ])
    return queues(spark, names, paused=["q3"]), runs(spark, jobs), plans


def _queue_walk(board, limit, sort_by, direction):
    pages, cursor = [], None
    while True:
        page = q.queues_page(*board, cursor=cursor, limit=limit, sort_by=sort_by, sort_direction=direction)
        pages += [(r[sort_by], r.name) for r in page.rows.orderBy("position").collect()]
        c = page.cursors.first()
        if c.next_name is None:
            return pages
        cursor = q.QueueCursor(c.next_name, c.next_waiting_jobs, c.next_active_jobs, c.next_pressure)


@pytest.mark.parametrize("sort_by, direction", [("waiting_jobs", "desc"), ("active_jobs", "asc")])
def test_queue_pages_concatenate(board, sort_by, direction):
    rows = _queue_walk(board, 4, sort_by, direction)
    sign = -1 if direction == "desc" else 1
    assert rows == sorted(rows, key=lambda r: (sign * r[0], r[1])) and len(rows) == 10


def test_queue_page_back(board):
    first = q.queues_page(*board, limit=4)
    c = first.cursors.first()
    second = q.queues_page(*board, limit=4, cursor=q.QueueCursor(c.next_name, c.next_waiting_jobs))
    c = second.cursors.first()
    back = q.queues_page(*board, limit=4, cursor=q.QueueCursor(c.prev_name, c.prev_waiting_jobs), cursor_direction="prev")
    names = lambda page: [r.name for r in page.rows.orderBy("position").collect()]
    assert names(back) == names(first)


def test_scheduler_lists(board):
    rows = {r.name: r for r in q.queues_page(*board).rows.collect()}
    assert (rows["q1"].patterns, rows["q1"].everys) == (["a", "z"], [7])
    assert (rows["idle"].patterns, rows["idle"].everys, rows["idle"].waiting_jobs) == ([], [3], 0)
    assert rows["q3"].is_paused and rows["q2"].patterns == []


def test_pressure_inputs_are_checked(board):
    with pytest.raises(ValueError):
        q.queues_page(*board, sort_by="pressure")
    with pytest.raises(ValueError):
        q.queues_page(*board, rollup=board[1], sort_by="pressure", pressure_from=T0, pressure_to=T0)


def test_name_pages(board):
    names = sorted(r.name for r in board[0].collect())
    first = q.queue_names_page(board[0], limit=4)
    assert [r.name for r in first.rows.orderBy("position").collect()] == names[:4]
    assert tuple(first.cursors.first()) == (names[4], None)
    third = q.queue_names_page(board[0], cursor=names[8], limit=4)
    # Five rows lie before the cursor: the page before starts at the last but one of them.
    assert tuple(third.cursors.first()) == (None, names[4])
    second = q.queue_names_page(board[0], cursor=names[4], limit=4)
    assert tuple(second.cursors.first()) == (names[8], None)
