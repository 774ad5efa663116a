"""Statistics kept by deltas against statistics computed anew."""

import random
from datetime import timedelta

import pytest

from rows import T0, event, events, run, runs
from runloom.operators import deltas, upsert as up
from runloom.operators.rollup import hourly_rollup
from runloom.sources import tables

HOUR = timedelta(hours=1)


def same(a, b):
    columns = sorted(set(b.columns) - {"updated_at"})
    assert sorted(map(tuple, a.select(columns).collect()), key=str) == sorted(map(tuple, b.select(columns).collect()), key=str)


def batch(spark, deal, n):
    rows = {}
    for k in range(n):
        job, at = str(deal.randrange(40)), T0 + deal.randrange(30) * HOUR
        status = deal.choice(["waiting", "active", "completed", "completed", "failed", "delayed"])
        started = at + timedelta(milliseconds=deal.randrange(50)) if status != "waiting" else None
        finished = started + timedelta(milliseconds=deal.choice([1, 5, 5, 9, 40])) if status in ("completed", "failed") else None
        rows[job, at] = event(k, status, job_id=job, queue=f"q{int(job) % 3}", created_at=at, enqueued_at=at, started_at=started, finished_at=finished)
    return up.fold(events(spark, list(rows.values())))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_upserts(spark, folder, seed):
    deal = random.Random(seed)
    hours, table = f"{folder}/hours", f"{folder}/runs"
    tables.write_runs(batch(spark, deal, 150), table, versioned=True)
    tables.write_rollup(hourly_rollup(tables.read_table(spark, table), T0), hours, versioned=True)
    for _ in range(3):
        changes = tables.upsert_table(table, batch(spark, deal, 80), images=True)
        deltas.maintain(spark, hours, changes, tables.read_table(spark, table), T0)
        same(tables.read_table(spark, hours).drop("bucket_date"), hourly_rollup(tables.read_table(spark, table), T0))


def done(job, took, status="completed"):
    start = T0 + timedelta(milliseconds=5)
    return run(job, status=status, started_at=start, finished_at=start + timedelta(milliseconds=took))


def stale_after(spark, stored, fresh):
    stored = runs(spark, stored)
    fresh = up.fold(events(spark, [event(9, r["status"], job_id=r["job_id"], started_at=r["started_at"], finished_at=r["finished_at"])
                                   for r in fresh]))
    changes = up.upsert_changes(stored, fresh, images=True)
    return deltas.apply_deltas(hourly_rollup(stored, T0), deltas.rollup_deltas(deltas.signed_images(changes)), T0)


def test_only_a_retracted_extreme_is_stale(spark):
    stored = [done("1", 10), done("2", 20), done("3", 30)]
    assert [(r.duration_min_ms, r.duration_max_ms, r._stale) for r in stale_after(spark, stored, [done("2", 25)]).collect()] == [(10, 30, False)]
    assert [r._stale for r in stale_after(spark, stored, [done("1", 15)]).collect()] == [True]
    # One as good came.
    assert [(r.duration_min_ms, r._stale) for r in stale_after(spark, stored, [done("1", 8)]).collect()] == [(8, False)]
    assert [r._stale for r in stale_after(spark, stored, [done("3", 12)]).collect()] == [True]
    # New runs never make it stale.
    assert [(r.total_runs, r.duration_max_ms, r._stale) for r in stale_after(spark, stored, [done("4", 99)]).collect()] == [(4, 99, False)]


def test_stored_runs_are_not_read_without_need(spark):
    stored = [done("1", 10), done("2", 20), done("3", 30)]
    touched = stale_after(spark, stored, [done("2", 25)])
    read = spark.sparkContext.accumulator(0)

    from pyspark.sql import functions as F

    @F.udf("boolean")
    def counted(_):
        read.add(1)
        return True

    table = runs(spark, stored).repartition(2).filter(counted("id"))
    assert deltas.with_extremes(touched, table).count() == 1
    assert read.value == 0
    again = stale_after(spark, stored, [done("1", 15)])
    assert [(r.duration_min_ms, r.duration_max_ms) for r in deltas.with_extremes(again, runs(spark, [done("1", 15), *stored[1:]])).collect()] == [(15, 30)]


def test_unchanged_images_add_nothing(spark):
    stored = runs(spark, [done("1", 10)])
    fresh = up.fold(events(spark, [event(9, "completed", job_id="1", name="renamed", started_at=done("1", 10)["started_at"],
                                         finished_at=done("1", 10)["finished_at"])]))
    changes = up.upsert_changes(stored, fresh, images=True)
    assert changes.count() == 1 and deltas.signed_images(changes).count() == 0
