from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rows import T0, queues, run, runs, schedulers
from runloom.functions.time import dashboard_window
from runloom.operators import audit, commands as cmd, dashboard, queues as q, reconcile as rc, retention as rt, rollup as r, tags as tg
from runloom.sources import tables

HOUR = timedelta(hours=1)
MS = timedelta(milliseconds=1)


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "name string, is_paused boolean, default_job_options string")


@pytest.mark.parametrize("complete, expected", [
    (True, {"a": "keep", "b": "delete", "c": "insert", "d": "update"}),
    (False, {"a": "keep", "b": "keep", "c": "insert", "d": "update"}),
])
def test_queue_scan(spark, complete, expected):
    seen = snapshot(spark, [("a", False, "{ }"), ("c", False, "{}"), ("d", True, '{"x":1}')])
    diff = rc.diff_queues(queues(spark, ["a", "b", "d"]), seen, complete)
    rows = {x.name: x for x in diff.collect()}
    assert {n: x._op for n, x in rows.items()} == expected
    assert rows["d"].changed_keys == ["default_job_options", "is_paused"]
    after = {x.name: x for x in rc.apply_queue_diff(diff, T0).collect()}
    assert sorted(after) == (["a", "c", "d"] if complete else ["a", "b", "c", "d"])
    assert after["a"].id == "id-a" and after["c"].created_at == T0 and after["d"].is_paused


def test_empty_scans(spark):
    stored, nothing = queues(spark, ["a", "b"]), snapshot(spark, [])
    assert {x._op for x in rc.diff_queues(stored, nothing, True).collect()} == {"delete"}
    assert {x._op for x in rc.diff_queues(stored, nothing, False).collect()} == {"keep"}


def test_scheduler_scan(spark):
    stored = schedulers(spark, [
        {"key": "same", "queue_id": "id-a", "every": 5, "end_date": T0}, {"key": "moved", "queue_id": "id-a"},
        {"key": "gone", "queue_id": "id-a"}, {"key": "elsewhere", "queue_id": "id-z"},
    ])
    listed = spark.createDataFrame(
        [("a", "same", "s", 5, T0), ("b", "moved", "s", None, None), ("b", "new", "s", None, None)],
        "queue string, key string, name string, every int, end_date timestamp_ntz",
    ).withColumns({c: F.lit(None).cast(t) for c, t in
                   {"limit": "int", "tz": "string", "pattern": "string", "template": "string"}.items()})
    rows = {x.key: x for x in rc.diff_schedulers(stored, listed, queues(spark, ["a", "b"])).collect()}
    assert {k: x._op for k, x in rows.items()} == {
        "same": "keep", "moved": "update", "gone": "delete", "elsewhere": "keep", "new": "insert"}
    assert rows["moved"].changed_keys == ["queue_id"]


def test_discovered_queues(spark):
    keys = spark.createDataFrame([("bull:a:id",), ("bull:a:id",), ("bull",), ("x:b",), ("bull:{c}:id",)], "key string")
    assert sorted(x.name for x in rc.discover_queues(keys).collect()) == ["a", "b", "{c}"]


def test_live_jobs(spark):
    stored = runs(spark, [run("1", status="waiting", tags=["t"]), run("2", status="active"), run("3", status="unknown"),
                          run("4", status="completed")])
    live = runs(spark, [run("1"), run("5", finished_at=T0, error_message="x")]).withColumn(
        "state", F.when(F.col("job_id") == "1", F.lit("active")))
    changes = {x.job_id: x for x in rc.reconcile_live(stored, live).collect()}
    assert (changes["1"].status, changes["1"].tags, changes["1"]._op) == ("active", ["t"], "update")
    assert (changes["5"].status, changes["5"]._op) == ("failed", "insert")
    assert sorted(x.job_id for x in rc.reconcile_missing(stored, live, queues(spark, ["q1"])).collect()) == ["2", "3"]


def test_queues_that_were_not_scanned_are_left_alone(spark):
    stored = runs(spark, [run("1"), run("2", queue="q2", created_at=T0 - 48 * HOUR)])
    live = spark.createDataFrame([], "queue string, job_id string, state string")
    assert [x.job_id for x in rc.reconcile_missing(stored, live, queues(spark, ["q1"])).collect()] == ["1"]
    assert rc.stalled(stored, live, T0, queues(spark, ["q1"])).count() == 0


def test_stalled_runs(spark):
    old, fresh = T0 - 24 * HOUR, T0 - 24 * HOUR + MS
    stored = runs(spark, [run("gone", created_at=old), run("moved", created_at=old, status="active"), run("same", created_at=old),
                          run("fresh", created_at=fresh), run("delayed", created_at=old, status="delayed")])
    live = spark.createDataFrame([("q1", "moved", "completed"), ("q1", "same", "waiting")], "queue string, job_id string, state string")
    got = {x.job_id: (x.action, x.status, x.error_message) for x in rc.stalled(stored, live, T0, queues(spark, ["q1"])).collect()}
    assert got == {"gone": ("fail", "failed", "Job stalled"), "moved": ("resend", "active", None)}


def test_name_resolution_prefers_the_exact_name(spark):
    names = spark.createDataFrame([("q1",), ("{q1}",), ("q2",), ("{q3}",), ("q4",)], "queue_name string")
    stored = queues(spark, ["q1", "{q1}", "{q2}", "q3"])
    got = {x.queue_name: x.resolved for x in cmd.resolve_queue_names(names, stored).collect()}
    assert got == {"q1": "q1", "{q1}": "{q1}", "q2": "{q2}", "{q3}": "q3", "q4": None}


def test_cancelling_judges_each_run(spark):
    later = T0 + HOUR
    stored = runs(spark, [run("1", status="completed"), run("1", id="again", enqueued_at=later), run("2", status="failed", error_message="e")])
    wanted = spark.createDataFrame([("1", "{q1}"), ("2", "q1"), ("3", "q1"), ("1", "other")], "job_id string, queue_name string")
    got = {(x.queue_name, x.job_id, x.id): (x.outcome, x.status, x.error_message)
           for x in cmd.cancel_jobs(wanted, stored, queues(spark, ["q1"])).collect()}
    assert got == {
        ("{q1}", "1", "q1/1"): ("already_finished", "completed", None),
        ("{q1}", "1", "again"): ("cancelled", "failed", "Job cancelled"),
        ("q1", "2", "q1/2"): ("already_finished", "failed", "e"),
        ("q1", "3", None): ("job_not_found", None, None),
        ("other", "1", None): ("queue_not_found", None, None),
    }


def test_pausing_and_deleting(spark):
    stored = queues(spark, ["a", "{b}", "c"], paused=["c"])
    wanted = spark.createDataFrame([("a",), ("b",), ("a",), ("zz",)], "queue_name string")
    assert {x.name for x in cmd.set_paused(wanted, stored, True).collect() if x.is_paused} == {"a", "{b}", "c"}
    assert cmd.set_paused(wanted, stored, True).schema.names == stored.schema.names
    plans = schedulers(spark, [{"key": "k1", "queue_id": "id-{b}"}, {"key": "k2", "queue_id": "id-c"}])
    kept, kept_plans = cmd.delete_queues(wanted, stored, plans)
    assert [x.name for x in kept.collect()] == ["c"] and [x.key for x in kept_plans.collect()] == ["k2"]


def test_replay_drops_what_must_not_be_inherited(spark):
    jobs = spark.createDataFrame(
        [("q", "n", '{"z":1}', '{"attempts":2,"delay":9,"jobId":"x","repeat":{"every":1},"repeatJobKey":"k","timestamp":5}')],
        "queue string, name string, data string, opts string")
    row = cmd.enqueue_messages(cmd.replay_rows(jobs)).first()
    assert tuple(row) == ("q", '{"queue":"q","name":"n","data":{"z":1},"opts":{"attempts":2}}')


# Statistics.

def test_bucket_edges_and_counted_statuses(spark):
    day = datetime(2024, 1, 11)
    rows = [run("1", status="completed", created_at=day - MS, started_at=T0, finished_at=T0 + 5 * MS),
            run("2", status="delayed", created_at=day), run("3", status="completed", created_at=day),
            run("4", status="failed", created_at=day, started_at=T0 + 7 * MS, finished_at=T0 + 9 * MS)]
    got = {x.bucket_start: x for x in r.hourly_rollup(runs(spark, rows), T0).collect()}
    assert sorted(got) == [day - HOUR, day]
    assert (got[day].total_runs, got[day].completed_runs, got[day].failed_runs) == (3, 1, 1)
    assert (got[day].duration_count, got[day].duration_total_ms, got[day].duration_min_ms) == (0, 0, None)
    assert (got[day].pressure_total_ms, got[day].pressure_count) == (7, 1)
    assert (got[day - HOUR].duration_total_ms, got[day - HOUR].duration_max_ms) == (5, 5)


def test_statistics_of_statistics_equal_those_of_runs(spark, smallest):
    from runloom.plans import fixture as fx

    table, window = fx.job_runs(spark, smallest), dashboard_window(fx.AS_OF, 30)
    by_hour = dashboard.queue_performance(r.hourly_rollup(table, fx.AS_OF), window)
    direct = table.groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("f"))
    assert {x.queue: (x.total_runs, x.failures) for x in by_hour.collect()} == {x.queue: (x.n, x.f) for x in direct.collect()}


def test_an_hour_that_became_empty_is_replaced(spark, folder):
    path, hour = f"{folder}/hours", datetime(2024, 1, 10, 12)
    table = runs(spark, [run("1"), run("2", "q2"), run("3", created_at=T0 - HOUR)])
    tables.write_rollup(r.hourly_rollup(table, T0), path)
    assert tables.read_table(spark, path).count() == 3
    tables.write_rollup_hour(r.refresh_hour(table.filter("job_id = '1'"), T0 + HOUR), path, hour)
    assert sorted(x.queue for x in tables.read_table(spark, path).collect()) == ["q1", "q1"]
    tables.write_rollup_hour(r.refresh_hour(table.filter("false"), T0 + HOUR), path, hour)
    assert tables.read_table(spark, path).count() == 1


def test_late_finish_is_repaired(spark):
    before = runs(spark, [run("1", status="active"), run("2", created_at=T0 - HOUR)])
    after = runs(spark, [run("1", status="completed", started_at=T0, finished_at=T0 + MS), run("2", created_at=T0 - HOUR)])
    fresh = r.refresh_touched(after, after.filter("job_id = '1'"), T0)
    assert [(x.bucket_start, x.completed_runs, x.active_runs) for x in fresh.collect()] == [(T0, 1, 0)]
    merged = r.merge_columns(r.hourly_rollup(before, T0), fresh)
    assert {x.bucket_start: x.completed_runs for x in merged.collect()} == {T0: 1, T0 - HOUR: 0}


def test_ties_and_safe_ratios(spark):
    table = runs(spark, [run("1", "b", status="active"), run("2", "a", status="active"), run("3", "c", status="failed")])
    perf = dashboard.queue_performance(r.hourly_rollup(table, T0), dashboard_window(T0 + HOUR, 1))
    assert [x.queue for x in dashboard.top_by_count(perf, 3).collect()] == ["a", "b", "c"]
    assert dashboard.top_by_duration(perf).count() == 0
    row = perf.filter("queue = 'c'").first()
    assert (row.error_rate, row.avg_duration, row.min_duration) == (100.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        dashboard.top_by_count(perf, 21)
    with pytest.raises(ValueError):
        dashboard.sort_performance(perf, "colour")


def test_pressure_rounds_half_up_and_needs_a_count(spark):
    rows = [run("1", "a", status="failed", started_at=T0 + MS), run("2", "a", status="failed", started_at=T0 + 2 * MS),
            run("3", "b", status="waiting")]
    got = {x.queue: x.pressure for x in dashboard.pressure_per_queue(r.hourly_rollup(runs(spark, rows), T0)).collect()}
    assert got == {"a": 2, "b": None}


def test_graph_and_chart_fill_gaps(spark):
    table = runs(spark, [run("1", status="completed")])
    hours = r.hourly_rollup(table, T0)
    as_of = T0 + 3 * HOUR + 20 * MS
    graph = dashboard.run_graph(hours, dashboard_window(as_of, 7)).collect()
    assert len(graph) == 7 * 24 + 1 and sum(x.run_count for x in graph) == 1
    assert dashboard.run_graph(hours, dashboard_window(as_of, 30)).count() == 31
    now = runs(spark, [run("1", status="completed"), run("2", status="failed", created_at=T0 + 3 * HOUR)])
    chart = q.queue_chart(["q1", "idle"], hours, now, as_of, 1).collect()
    assert len(chart) == 50
    assert {(x.queue, x.timestamp): (x.completed, x.failed) for x in chart if x.completed or x.failed} == {
        ("q1", "2024-01-10 12:00:00"): (1, 0), ("q1", "2024-01-10 15:00:00"): (0, 1)}


# Tags and retention.

def test_catalogue_and_search(spark):
    rows = [run("1", tags=["Alpha", None, "", "beta"]), run("2", tags=None), run("3", tags=["alpine", "BETA"], created_at=T0 + HOUR)]
    catalogue = tg.tag_catalogue(runs(spark, rows), T0)
    assert sorted(x.tag for x in catalogue.collect()) == ["Alpha", "BETA", "alpine", "beta"]
    find = lambda text: [x.tag for x in tg.search_tags(catalogue, text).collect()]
    assert find("a") == find(None) == find("  ") == []
    assert find("AL") == ["Alpha", "alpine"] and find("et") == [] and find("eta") == ["BETA", "beta"]
    again = tg.upsert_tags(catalogue, tg.tag_catalogue(runs(spark, rows[:1]), T0 + HOUR))
    row = again.filter("tag = 'alpine'").first()
    assert (row.last_seen_at, row.updated_at) == (T0 + HOUR, T0)
    assert again.filter("tag = 'beta'").first().updated_at == T0 + HOUR


def test_retention_boundaries(spark):
    edge = T0 - HOUR
    table = runs(spark, [run("1", created_at=edge), run("2", created_at=edge - MS)])
    assert [x.job_id for x in rt.keep_runs(table, T0, HOUR).collect()] == ["1"]
    logs = spark.createDataFrame([("a", "q1/1"), ("b", "q1/2"), ("c", "q1/2"), ("d", "no run")], "id string, job_run_id string")
    assert sorted(x.id for x in rt.keep_logs(logs, table, T0, HOUR).collect()) == ["a", "d"]
    assert rt.keep_runs(table, T0, None).count() == 2 and rt.keep_logs(logs, table, T0, None).count() == 4


def test_audit_of_a_clean_and_a_lacking_run(spark):
    expected = spark.createDataFrame([("1", 0, 5, False, 0), ("2", 1, 6, True, 3)],
                                     "job_id string, index int, wait int, should_fail boolean, payload_length int")
    data = ['{"wait":5,"shouldFail":false,"stress":{"index":0,"runId":"r"}}',
            '{"wait":6,"shouldFail":true,"stress":{"index":1,"runId":"r","payload":"xxx"}}']
    table = runs(spark, [run("1", "{d}", name="n", status="completed", data=data[0]), run("2", "{d}", name="n", status="failed", data=data[1]),
                         run("3", "{d}", data='{"stress":{"runId":"other"}}')])
    logs = table.select(F.col("id").alias("job_run_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("log_seq"))
    row = audit.tallies(audit.compare(expected, table, "r", "{d}", "n"), logs, table, "r").first()
    assert row.verified and (row.found_jobs, row.terminal, row.found_logs) == (2, 2, 4)
    lacking = table.filter("job_id = '1'").withColumn("status", F.lit("failed"))
    compared = audit.compare(expected, lacking, "r", "{d}", "other name")
    assert sorted(x.reason for x in audit.mismatches(compared).collect()) == ["payload_mismatch", "unexpected_failure"]
    row = audit.tallies(compared, logs, lacking, "r").first()
    assert (row.missing_jobs, row.mismatches, row.verified) == (1, 2, False)
