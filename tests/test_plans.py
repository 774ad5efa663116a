"""Properties that plans must have at any size."""

import re

import pytest

import __spark_entry__ as entry
from rows import T0, run, runs
from runloom.operators import queues as q, rollup as r, upsert as up
from runloom.plans import fixture as fx
from runloom.sources import tables

BATCH = [n for n in sorted(entry.queries()) if not n.startswith("stream_")]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_query_pairs_all_rows_or_leaves_the_engine(name, spark, smallest):
    text = plan(entry.queries()[name](spark, smallest))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


def test_the_rollup_shuffles_partial_aggregates_once(spark, smallest):
    text = plan(r.hourly_rollup(fx.job_runs(spark, smallest), fx.AS_OF))
    assert text.count("Exchange") == 1
    assert text.index("functions=[count(1)") < text.index("Exchange") < text.index("partial_count(1)")
    # Payload columns are not read.
    assert "props" not in text


def test_a_batch_is_reduced_before_its_shuffle(spark, smallest):
    text = plan(up.fold_states(fx.job_runs(spark, smallest).withColumnRenamed("duration_ms", "seq")))
    assert text.index("Exchange hashpartitioning") < text.index("partial_max_by")


def test_the_list_does_not_read_payloads(spark, folder):
    tables.write_runs(runs(spark, [run("1", "q1"), run("2", "q2")]), folder)
    stored = tables.read_table(spark, folder)
    text = plan(q.live_counts(stored))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert schema == "queue:string,status:string"
    assert "PushedFilters: [In(status" in text


def test_touched_hours_prune_dates_without_moving_the_runs(spark, folder):
    tables.write_runs(runs(spark, [run("1", "q1"), run("2", "q2")]), folder)
    stored = tables.read_table(spark, folder)
    text = plan(r.refresh_touched(stored, runs(spark, [run("1")]), T0))
    assert "dynamicpruning" in text
    assert "SortMergeJoin" not in text


def test_the_chart_sends_its_names_to_the_scan(spark, folder):
    tables.write_runs(runs(spark, [run("1", "q1")]), folder)
    stored = tables.read_table(spark, folder)
    text = plan(q.queue_chart(["q1", "q2"], r.hourly_rollup(stored, T0), stored, T0, 1))
    assert "In(queue, [q1,q2])" in text
