"""What stored tables need not read: files without a pattern, row groups without an id, dates off the page."""

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rows import T0, run, runs
from runloom.functions.text import contains_ci
from runloom.operators import dashboard as d, logs as lg, queues as q, rollup as r, search as js, trigrams
from runloom.schemas import JOB_LOGS
from runloom.sources import tables
from runloom.streaming import ingest

HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def metric(frame, node, name):
    """A number of the plan's run, summed over nodes. A second run of the same plan would count from nothing."""
    frame.collect()
    return metric_of(frame, node, name)


def scanned(frame):
    """Partitions that the scans of a plan opened."""
    return metric_of(frame, "Scan parquet", "numPartitions")


def metric_of(frame, node, name):
    found, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        each = todo.pop()
        if each.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(each.executedPlan())
            continue
        if node in each.nodeName():
            found += each.metrics().apply(name).value()
        for plans in (each.children(), each.subqueries()):
            todo += [plans.apply(k) for k in range(plans.size())]
        if "QueryStage" in each.nodeName():
            todo.append(each.plan())
    return found


def days(spark, folder, n=16, each=8, versioned=True):
    at = lambda k, j: {"created_at": T0 + k * DAY + j * HOUR, "enqueued_at": T0 + k * DAY + j * HOUR}
    rows = [run(f"{k}-{j}", f"q{j % 3}", **at(k, j), error_message=f"failed at step {k}x{j}") for k in range(n) for j in range(each)]
    tables.write_runs(runs(spark, rows), folder, versioned=versioned)
    return rows


# Trigrams.


def test_search_reads_listed_files_only(spark, folder):
    days(spark, f"{folder}/runs")
    table, index = f"{folder}/runs", f"{folder}/index"
    trigrams.write_postings(tables.read_table(spark, table), ["name", "error_message"], index)
    found = trigrams.search(spark, table, index, ["name", "error_message"], "STEP 7X3")
    assert [x.job_id for x in found.collect()] == ["7-3"]
    assert len(found.inputFiles()) == 1 < len(tables.read_table(spark, table).inputFiles())
    assert trigrams.search(spark, table, index, ["error_message"], "no such step").collect() == []


@pytest.mark.parametrize("pattern", ["at", "a_ step", "step 1%3", "5x", "ÄÖ", "100\\%", "", "STEP 12x0", "x%x%x", "İ"])
def test_same_rows_as_without_an_index(spark, folder, pattern):
    table, index = f"{folder}/runs", f"{folder}/index"
    rows = [run(str(k), created_at=T0 + k * DAY, error_message=text) for k, text in enumerate(
        ["failed at step 12x0", None, "", "äöü ÄÖÜ", "100% of it", "x1x2x", "i̇ İ", "failed AT STEP 5X", "a"])]
    tables.write_runs(runs(spark, rows), table, versioned=True)
    trigrams.write_postings(tables.read_table(spark, table), ["error_message"], index)
    plain = tables.read_table(spark, table).filter(contains_ci(F.col("error_message"), pattern))
    found = trigrams.search(spark, table, index, ["error_message"], pattern)
    assert sorted(x.job_id for x in found.collect()) == sorted(x.job_id for x in plain.collect())


def test_files_written_after_the_index_are_searched_and_can_be_added(spark, folder):
    table, index = f"{folder}/runs", f"{folder}/index"
    days(spark, table, n=3)
    trigrams.write_postings(tables.read_table(spark, table), ["error_message"], index)
    tables.write_runs(runs(spark, [run("new", created_at=T0 + 9 * DAY, error_message="failed at step 1x1 again")]), table)
    tables.write_runs(runs(spark, [run("instead", created_at=T0, error_message="nothing")]), table)
    for _ in range(2):
        found = trigrams.search(spark, table, index, ["error_message"], "step 1x1")
        assert sorted(x.job_id for x in found.collect()) == ["1-1", "new"]
        trigrams.add_postings(tables.read_table(spark, table), ["error_message"], index)
    files = len(tables.read_table(spark, table).inputFiles())
    assert tables.read_table(spark, index).filter("trigram = ''").count() == files
    assert len(trigrams.search(spark, table, index, ["error_message"], "step 1x1").inputFiles()) == 2


# Point lookups.


def test_bloom_filters_skip_row_groups(spark, folder):
    deal = random.Random(1)
    ids = [f"{deal.getrandbits(128):032x}" for _ in range(20_000)]
    rows = spark.createDataFrame([(i, f"j{i}", T0, "x" * 200) for i in ids], "id string, job_id string, created_at timestamp_ntz, body string")
    spark.conf.set("parquet.block.size", str(1 << 18))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(1 << 18))
    hadoop.set("parquet.page.row.count.limit", "1000")
    try:
        tables.write_runs(rows, folder, versioned=True)
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.row.count.limit")
        spark.conf.unset("parquet.block.size")
    stored = tables.read_table(spark, folder)
    missing = stored.filter(F.col("id") == "0" * 31 + "g")
    assert missing.count() == 0
    hit = stored.filter(F.col("id") == ids[7]).select("body")
    assert hit.count() == 1
    read = metric(stored.filter(F.col("id") == ids[7]).select("id", "body"), "Scan parquet", "numOutputRows")
    assert 0 < read < 20_000 / 2


def test_detail_opens_the_date_of_the_run(spark, folder):
    rows = days(spark, folder)
    stored = tables.read_table(spark, folder)
    one = lambda: js.job_detail(stored, rows[20]["id"], created_at=rows[20]["created_at"])
    assert [x.job_id for x in one().collect()] == [rows[20]["job_id"]]
    assert metric(one(), "Scan parquet", "numFiles") == 1
    many = js.job_detail(stored, runs(spark, [rows[3], rows[100]]).select("id", "created_at"))
    assert sorted(x.job_id for x in many.collect()) == sorted([rows[3]["job_id"], rows[100]["job_id"]])
    assert "dynamicpruning" in plan(many)
    keyed = js.jobs_by_key(stored, runs(spark, [rows[3]]).select("queue", "job_id", "enqueued_at"))
    assert "dynamicpruning" in plan(keyed)
    lines = spark.createDataFrame([("q0", "3-0", rows[24]["created_at"])], "queue string, job_id string, job_timestamp timestamp_ntz")
    attached = lg.attach_runs(lines, stored)
    assert "dynamicpruning" in plan(attached) and attached.first().job_run_id == rows[24]["id"]


# Pages.


@pytest.mark.parametrize("sort", ["asc", "desc"])
def test_stored_pages_concatenate_to_the_order(spark, folder, sort):
    rows = days(spark, folder, n=6, each=7)
    stored, dates = tables.read_table(spark, folder), tables.dates_of(spark, folder, "created_date")
    expected = [x["job_id"] for x in sorted(rows, key=lambda x: (x["created_at"], x["job_id"]), reverse=sort == "desc")]
    got, cursor, pages = [], None, []
    while True:
        page = js.stored_page(stored, dates, cursor, sort_direction=sort, limit=10).orderBy("position").collect()
        got += [x.job_id for x in page]
        pages.append(page)
        if page[0].next_cursor is None:
            break
        c = page[0].next_cursor
        cursor = js.JobCursor(c.created_at, c.job_id, c.id, c.duration_ms)
    assert got == expected and pages[0][0].prev_cursor is None
    c = pages[-1][0].prev_cursor
    back = js.stored_page(stored, dates, js.JobCursor(c.created_at, c.job_id, c.id), "prev", sort, 10).orderBy("position").collect()
    assert [x.job_id for x in back] == [x.job_id for x in pages[-2]]
    assert js.stored_page(stored, [], limit=5).collect() == []


def test_first_page_reads_one_date(spark, folder, monkeypatch):
    days(spark, folder, n=30)
    seen = []
    stored, dates = tables.read_table(spark, folder), tables.dates_of(spark, folder, "created_date")
    assert len(dates) == 30
    collect = type(stored).collect

    def counted(self):
        rows = collect(self)
        seen.append(scanned(self))
        return rows

    monkeypatch.setattr(type(stored), "collect", counted)
    page = js.stored_page(stored, dates, limit=5)
    monkeypatch.undo()
    assert seen == [1]
    assert [x.position for x in page.orderBy("position").collect()] == [1, 2, 3, 4, 5]


def test_a_deep_offset_reads_one_date(spark, folder):
    rows = [(str(k), "r" if k % 9 else "other", "log", f"m{k}", T0 + k * timedelta(minutes=7), k % 3) for k in range(2000)]
    tables.write_logs(spark.createDataFrame(rows, JOB_LOGS), folder, versioned=True)
    stored = tables.read_table(spark, folder)
    counts = lg.line_counts(stored)
    for offset, limit in ((0, 10), (1700, 20), (1770, 100), (5000, 10), (8, 1)):
        page = lg.stored_logs_page(stored, counts, "r", limit, offset)
        assert page.orderBy("position").collect() == lg.logs_page(lg.filter_logs(stored, run_id="r"), limit, offset).orderBy("position").collect()
    assert metric(lg.stored_logs_page(stored, counts, "r", 5, 1500), "Scan parquet", "numFiles") == 1


# Plans.


def test_live_counts_push_their_statuses(spark, folder):
    days(spark, folder, n=2)
    stored = tables.read_table(spark, folder)
    window = __import__("runloom.functions.time", fromlist=["dashboard_window"]).dashboard_window(T0, 1)
    for frame in (d.totals(stored, r.hourly_rollup(stored, T0), window), q.system_overview(stored, queues(spark), schedulers(spark))):
        assert "PushedFilters: [In(status, [active,waiting])]" in plan(frame) or "In(status, [active,waiting])" in plan(frame)
    text = plan(q.job_stats(stored, T0, 2))
    assert re.search(r"PushedFilters: \[Or\(EqualTo\(status,active\)", text)


def queues(spark):
    from rows import queues as make

    return make(spark, ["q0", "q1"])


def schedulers(spark):
    from rows import schedulers as make

    return make(spark, [{"key": "k", "queue_id": "id-q0"}])


def test_the_latest_run_is_found_without_sorting_payloads(spark, folder):
    rows = days(spark, folder, n=3)
    rows[-1]["data"] = '{"a":1}'
    tables.write_runs(runs(spark, rows), folder)
    stored = tables.read_table(spark, folder)
    assert "SortAggregate" not in plan(q.last_run_data(stored))
    got = {x.queue: x.data for x in q.last_run_data(stored).collect()}
    assert got[rows[-1]["queue"]] == '{"a":1}' and len(got) == 3


def test_ties_go_to_the_larger_job_id(spark):
    tied = [run("1", data="a"), run("3", data="c"), run("2", data="b")]
    assert [x.data for x in q.last_run_data(runs(spark, tied)).collect()] == ["c"]


# The buffer.


def test_buffer_is_drained_empty_while_ingestion_goes_on(spark, folder):
    from rows import T0 as at

    line = lambda job, k: ("q", job, at, at, k, "log", "m")
    kinds = "queue string, job_id string, job_timestamp timestamp_ntz, log_timestamp timestamp_ntz, log_seq int, level string, message string"
    known = spark.createDataFrame([("q", "a", at, "id-a"), ("q", "b", at, "id-b")], "queue string, job_id string, enqueued_at timestamp_ntz, id string")
    buffer = ingest._buffer(spark, folder)

    def wait(lines, batch):
        attached = lg.attach_runs(spark.createDataFrame(lines, kinds), known.limit(0))
        buffer.replace(lg.unresolved(attached, at).withColumn("batch_id", F.lit(batch)), [str(batch)])

    ingest.drain_buffer(spark, folder, known)
    wait([line("a", 0), line("b", 1)], 0)
    first = ingest._buffer(spark, folder)
    replace = first.files.__class__.create
    try:
        # A batch arrives while the drain is at work.
        def slow(self, name, text):
            first.files.__class__.create = replace
            wait([line("a", 7)], 1)
            return replace(self, name, text)

        first.files.__class__.create = slow
        ingest.drain_buffer(spark, folder, known)
    finally:
        first.files.__class__.create = replace
    assert [(x.job_id, x.log_seq) for x in ingest.current_buffer(spark, folder).collect()] == [("a", 7)]
    ingest.drain_buffer(spark, folder, known)
    assert ingest.current_buffer(spark, folder).collect() == []
    ingest.drain_buffer(spark, folder, known)
    assert sorted((x.job_run_id, x.log_seq) for x in ingest.current_logs(spark, folder).collect()) == [("id-a", 0), ("id-a", 7), ("id-b", 1)]
    with pytest.raises(ValueError):
        ingest.drain_buffer(spark, folder, known, batch_id=_taken(spark, folder))


def _taken(spark, folder):
    import os

    return int(next(f for f in os.listdir(f"{folder}/logs") if f.startswith("batch_id=")).removeprefix("batch_id="))


def test_a_drain_that_dies_loses_nothing(spark, folder, monkeypatch):
    kinds = "queue string, job_id string, job_timestamp timestamp_ntz, log_timestamp timestamp_ntz, log_seq int, level string, message string"
    known = spark.createDataFrame([("q", "a", T0, "id-a")], "queue string, job_id string, enqueued_at timestamp_ntz, id string")
    lines = spark.createDataFrame([("q", "a", T0, T0, 0, "log", "m"), ("q", "x", T0, T0, 0, "log", "m")], kinds)
    ingest._buffer(spark, folder).replace(
        lg.unresolved(lg.attach_runs(lines, known.limit(0)), T0).withColumn("batch_id", F.lit(0)), ["0"])

    from runloom.sources import versions

    def die(*_):
        raise ConnectionError("the driver is gone")

    monkeypatch.setattr(versions._Files, "create", die)
    with pytest.raises(ConnectionError):
        ingest.drain_buffer(spark, folder, known)
    monkeypatch.undo()
    assert ingest.current_buffer(spark, folder).count() == 2
    ingest.drain_buffer(spark, folder, known)
    assert [x.job_id for x in ingest.current_buffer(spark, folder).collect()] == ["x"]
    assert [x.job_run_id for x in ingest.current_logs(spark, folder).collect()] == ["id-a"]
