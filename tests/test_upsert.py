import random
from datetime import timedelta

import pytest

from rows import T0, event, events, run, runs
from runloom.operators import upsert as up
from runloom.sources import tables

DONE = T0 + timedelta(seconds=5)


def folded(spark, rows, **options):
    return {(r.queue, r.job_id): r for r in up.fold(events(spark, rows), **options).collect()}


def test_terminal_status_sticks_but_times_are_cleared(spark):
    first = [event(1, "completed", started_at=T0, finished_at=DONE)]
    late = [event(2, "active", started_at=T0)]
    after = up.upsert_runs(up.fold(events(spark, first)), up.fold(events(spark, late))).first()
    assert (after.status, after.finished_at, after.duration_ms, after._op) == ("completed", None, None, "update")


def test_same_pair_inside_one_batch(spark):
    rows = [event(1, "completed", finished_at=DONE), event(2, "active")]
    assert folded(spark, rows)[("q1", "1")].status == "completed"
    assert folded(spark, rows, semantics="last_in_batch")[("q1", "1")].status == "active"
    split = [event(1, "completed", batch_id=0, finished_at=DONE), event(2, "active", batch_id=1)]
    assert folded(spark, split, semantics="last_in_batch")[("q1", "1")].status == "completed"
    with pytest.raises(ValueError):
        folded(spark, rows, semantics="other")


def test_tags_are_kept_until_others_come(spark):
    rows = [event(1, "waiting", tags=["a", "b"]), event(2, "active", tags=[]), event(3, "active", tags=None)]
    assert folded(spark, rows)[("q1", "1")].tags == ["a", "b"]
    current, incoming = up.fold(events(spark, rows[:1])), up.fold(events(spark, rows[1:]))
    assert up.upsert_runs(current, incoming).first().tags == ["a", "b"]
    changed = up.upsert_runs(current, up.fold(events(spark, [event(4, "active", tags=["c"])]))).first()
    assert changed.tags == ["c"]


def test_repeating_a_batch_changes_nothing(spark):
    batch = up.fold(events(spark, [event(1, "active", data='{"a":1}'), event(2, "failed", job_id="2", error_message="x")]))
    once = up.upsert_runs(runs(spark, []), batch)
    assert {r._op for r in once.collect()} == {"insert"}
    assert up.upsert_changes(once.drop("_op"), batch).count() == 0
    assert up.change_feed(up.upsert_runs(once.drop("_op"), batch)).count() == 0


def test_untouched_rows_stay(spark):
    current = up.fold(events(spark, [event(1, "active"), event(2, "waiting", job_id="2", tags=["t"])]))
    after = up.upsert_runs(current, up.fold(events(spark, [event(3, "failed", error_message="e")])))
    rows = {r.job_id: r for r in after.collect()}
    assert (rows["1"]._op, rows["1"].status) == ("update", "failed")
    assert (rows["2"]._op, rows["2"].status, rows["2"].tags) == ("keep", "waiting", ["t"])


def _one_by_one(rows):
    """The rules applied event by event."""
    table = {}
    for e in sorted(rows, key=lambda e: e[0]):
        seq, _, queue, job, enqueued, status, tags, *values = e
        old = table.get((queue, job, enqueued))
        if old:
            if old[0] in ("completed", "failed") and status not in ("completed", "failed"):
                status = old[0]
            tags = tags or old[1]
        table[(queue, job, enqueued)] = (status, tags or [], values)
    return table


def _random_events(seed, keys=40, count=600):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(10_000), count):
        # One key takes a third of all events.
        key = 0 if rng.random() < 0.34 else rng.randrange(keys)
        status = rng.choice(["waiting", "active", "completed", "failed", "delayed"])
        rows.append(event(
            seq, status, batch_id=seq // 1000, job_id=str(key), tags=rng.choice([None, [], ["a"], ["b", "c"]]),
            attempt=rng.randrange(5), error_message=rng.choice([None, "x"]),
            started_at=rng.choice([None, T0]), finished_at=rng.choice([None, DONE]),
        ))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_event_by_event_application(spark, seed):
    rows = _random_events(seed)
    expected = _one_by_one(rows)
    for frame in (events(spark, rows), events(spark, rows[::-1]).repartition(13)):
        got = {(r.queue, r.job_id, r.enqueued_at): r for r in up.fold(frame).collect()}
        assert got.keys() == expected.keys()
        for key, (status, tags, values) in expected.items():
            row = got[key]
            assert (row.status, row.tags) == (status, tags)
            assert (row.attempt, row.error_message, row.started_at, row.finished_at) == (
                values[1], values[11], values[14], values[15])


@pytest.mark.parametrize("parts", [2, 5])
def test_batches_of_any_size_give_the_same_table(spark, parts):
    rows = sorted(_random_events(7))
    size = len(rows) // parts + 1
    whole = {r.job_id: r for r in up.fold(events(spark, rows)).collect()}
    table = runs(spark, [])
    states = None
    for start in range(0, len(rows), size):
        batch = events(spark, rows[start:start + size])
        table = up.upsert_runs(table, up.fold(batch)).drop("_op")
        state = up.fold_states(batch)
        states = state if states is None else states.unionByName(state)
    order = sorted(table.columns)
    assert {r.job_id: r for r in table.select(order).collect()} == {k: v for k, v in _sorted(whole, order).items()}
    merged = {r.job_id: r for r in up.runs_of_states(up.merge_states(states)).select(order).collect()}
    assert merged == _sorted(whole, order)


def _sorted(rows, order):
    from pyspark.sql import Row

    return {k: Row(*order)(*[r[c] for c in order]) for k, r in rows.items()}


def test_retention_keeps_the_boundary_and_rows_without_time(spark):
    as_of, keep = T0, timedelta(hours=1)
    edge, late = T0 - keep, T0 - keep - timedelta(milliseconds=1)
    rows = [event(1, "active", job_id="edge", created_at=edge, enqueued_at=edge),
            event(2, "active", job_id="late", created_at=late, enqueued_at=late),
            event(3, "active", job_id="none", created_at=None, enqueued_at=None)]
    kept = up.within_retention(events(spark, rows), as_of, keep)
    assert sorted(r.job_id for r in kept.collect()) == ["edge", "none"]
    assert up.within_retention(events(spark, rows), as_of, None).count() == 3


def test_upsert_into_a_stored_table(spark, folder):
    path = f"{folder}/runs"
    day = timedelta(days=1)
    old = [run("1", status="active"), run("2", created_at=T0 + day, enqueued_at=T0 + day), run("3", status="failed")]
    tables.write_runs(runs(spark, old), path)
    batch = [event(1, "completed", started_at=T0, finished_at=DONE), event(2, "active", job_id="4")]
    changed = tables.upsert_table(path, up.fold(events(spark, batch)))
    assert {r.job_id: r._op for r in changed.collect()} == {"1": "update", "4": "insert"}
    stored = {r.job_id: r for r in tables.read_table(spark, path).collect()}
    assert {k: r.status for k, r in stored.items()} == {"1": "completed", "2": "waiting", "3": "failed", "4": "active"}
    assert stored["1"].duration_ms == 5000
    # The same batch again changes nothing.
    assert tables.upsert_table(path, up.fold(events(spark, batch))).count() == 0


def test_only_touched_dates_are_read(spark, folder):
    path = f"{folder}/runs"
    days = [T0 + timedelta(days=i) for i in range(5)]
    tables.write_runs(runs(spark, [run(str(i), created_at=d, enqueued_at=d) for i, d in enumerate(days)]), path)
    batch = up.fold(events(spark, [event(1, "active", job_id="1", created_at=days[1], enqueued_at=days[1])]))
    frame = up.touched_dates(tables.read_table(spark, path), batch)
    assert [r.job_id for r in frame.collect()] == ["1"]
    assert "dynamicpruning" in frame._jdf.queryExecution().executedPlan().toString()


def test_an_upsert_keeps_stored_rows_of_any_time(spark, folder):
    path, early = f"{folder}/runs", T0.replace(year=1969)
    old = [run(x, created_at=early, enqueued_at=early) for x in "ab"] + [run("c", created_at=early + timedelta(days=1))]
    assert tables.upsert_table(path, up.fold(events(spark, [event(0, "active", job_id=x, created_at=early, enqueued_at=early) for x in "ab"]))).count() == 2
    tables.write_runs(runs(spark, old), path)
    tables.upsert_table(path, up.fold(events(spark, [event(1, "active", job_id="d", created_at=early, enqueued_at=early)])))
    assert sorted(r.job_id for r in tables.read_table(spark, path).collect()) == ["a", "b", "c", "d"]


def test_outcomes_reach_the_stored_runs(spark, folder):
    path = f"{folder}/runs"
    tables.write_runs(runs(spark, [run("1"), run("2"), run("3", created_at=T0 + timedelta(days=1))]), path)
    outcomes = spark.createDataFrame([("q1/1", "failed", "Job cancelled")], "id string, status string, error_message string")
    tables.apply_outcomes(path, outcomes)
    assert {r.job_id: (r.status, r.error_message) for r in tables.read_table(spark, path).collect()} == {
        "1": ("failed", "Job cancelled"), "2": ("waiting", None), "3": ("waiting", None)}


def test_retention_deletes_folders_and_cuts_the_boundary_date(spark, folder):
    path = f"{folder}/runs"
    hours = [T0 + timedelta(hours=12 * i) for i in range(-4, 3)]
    tables.write_runs(runs(spark, [run(str(i), created_at=h) for i, h in enumerate(hours)]), path)
    tables.delete_before(spark, path, "created_date", "created_at", T0)
    stored = tables.read_table(spark, path)
    assert sorted(r.job_id for r in stored.collect()) == ["4", "5", "6"]
