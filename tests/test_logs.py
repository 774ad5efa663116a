from datetime import timedelta

import pytest

from rows import T0, run, runs
from runloom import schemas
from runloom.operators import logs as lg

LINES = "queue string, job_id string, job_timestamp timestamp_ntz, log_timestamp timestamp_ntz, log_seq int, level string, message string, seq long"


def line(seq, job_id="1", queue="q1", at=T0, no=0, message="m"):
    return (queue, job_id, T0, at, no, "log", message, seq)


def test_lines_wait_for_their_run(spark):
    events = spark.createDataFrame([line(1), line(2, "later"), line(3, "never"), line(4, message="copy")], LINES)
    known = runs(spark, [run("1")])
    attached = lg.attach_runs(lg.first_of_each(events, lg.BUFFER_KEY, "seq"), known)
    stored = lg.resolved(attached)
    assert [(r.job_run_id, r.message) for r in stored.collect()] == [("q1/1", "m")]
    assert lg.not_yet_stored(lg.resolved(attached), stored).count() == 0
    buffer = lg.unresolved(attached, T0)
    assert sorted(r.job_id for r in buffer.collect()) == ["later", "never"]

    soon = lg.drain(buffer, runs(spark, [run("1"), run("later")]), T0 + timedelta(minutes=59))
    assert {r.job_id: r.is_orphan for r in soon.collect()} == {"later": False, "never": False}
    drained = lg.drain(buffer, runs(spark, [run("later")]), T0 + timedelta(hours=1))
    assert {r.job_id: (r.job_run_id, r.is_orphan) for r in drained.collect()} == {
        "later": ("q1/later", False), "never": (None, True)}
    assert [r.job_id for r in lg.still_buffered(buffer, drained).collect()] == ["never"]
    assert tuple(lg.backlog(drained, T0 + timedelta(hours=1)).first()) == (2, T0, 3_600_000, 1, 1)


def test_empty_backlog(spark):
    empty = lg.drain(spark.createDataFrame([], schemas.JOB_LOG_BUFFER), runs(spark, []), T0)
    assert tuple(lg.backlog(empty, T0).first()) == (0, None, 0, 0, 0)


def test_the_same_job_id_in_two_queues_and_times(spark):
    other = T0 + timedelta(milliseconds=1)
    known = runs(spark, [run("1"), run("1", "q2"), run("1", id="again", enqueued_at=other, created_at=other)])
    events = spark.createDataFrame([line(1), line(2, queue="q2")], LINES)
    assert sorted(r.job_run_id for r in lg.resolved(lg.attach_runs(events, known)).collect()) == ["q1/1", "q2/1"]


@pytest.mark.parametrize("block", [3, 64, 1_000_000])
def test_numbers_of_a_hot_group_are_exact(spark, block):
    rows = [line(seq) for seq in range(0, 600, 2)] + [line(seq, str(seq % 7 + 2)) for seq in range(1, 600, 2)]
    numbered = lg.number_lines(spark.createDataFrame(rows, LINES).drop("log_seq").repartition(5), block=block)
    got = {r.seq: r.log_seq for r in numbered.collect()}
    counters, expected = {}, {}
    for row in sorted(rows, key=lambda r: r[-1]):
        expected[row[-1]] = counters.get(row[1], 0)
        counters[row[1]] = expected[row[-1]] + 1
    assert got == expected


def test_log_pages(spark):
    rows = [(f"l{i:02d}", "r" if i % 3 else "s", "warn" if i % 2 else "info", f"Line {i}%", T0 + timedelta(seconds=i // 4), i % 4)
            for i in range(24)]
    logs = spark.createDataFrame(rows, schemas.JOB_LOGS)
    of_run = lg.filter_logs(logs, run_id="r")
    ids = [r.id for r in of_run.orderBy("ts", "log_seq").collect()]
    pages = [[r.id for r in lg.logs_page(of_run, 5, o).orderBy("position").collect()] for o in (0, 5, 10, 15)]
    assert sum(pages, []) == ids
    assert [r.position for r in lg.logs_page(of_run, 5, 5).orderBy("position").collect()] == [6, 7, 8, 9, 10]
    assert lg.logs_total(lg.filter_logs(logs, level="warn", message_contains="LINE 1")).first().total == 6
    with pytest.raises(ValueError):
        lg.filter_logs(logs, level="fatal")
    with pytest.raises(ValueError):
        lg.logs_page(logs, limit=1001)


def test_timeline(spark):
    known = runs(spark, [
        run("1", delay_ms=1000, finished_at=T0 + timedelta(seconds=3)),
        run("2", enqueued_at=None),
        run("3", finished_at=T0),
    ])
    logs = spark.createDataFrame(
        [(str(i), f"q1/{i}", "log", "m", T0 + timedelta(seconds=2), 0) for i in (1, 2, 3)], schemas.JOB_LOGS)
    got = {r.id: r.position_pct for r in lg.timeline(logs, known, T0 + timedelta(seconds=8)).collect()}
    assert got == {"1": 50.0, "2": 25.0, "3": 0.0}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_unbounded_size_is_collected(spark):
    """Small files, as the tables here, may hold any number of lines; estimates of their size say nothing."""
    events = spark.createDataFrame([line(1), line(2, "never"), line(3, message="copy")], LINES)
    attached = lg.attach_runs(lg.first_of_each(events, lg.BUFFER_KEY, "seq"), runs(spark, [run("1")]))
    stored, buffer = lg.resolved(attached), lg.unresolved(attached, T0)
    drained = lg.drain(buffer, runs(spark, [run("never")]), T0)
    for df, rows in ((stored, 1), (lg.not_yet_stored(stored, stored), 0), (lg.still_buffered(buffer, drained), 0)):
        assert "Broadcast" not in plan_of(df)
        assert df.count() == rows
