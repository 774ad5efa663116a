"""Keyed state: the run machine, the feed by the clock, the join of two streams."""

import glob
import os
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rows import T0, event, events
from runloom.operators import upsert as up
from runloom.session import FREED, settings, shared_dir
from runloom.sources import tables
from runloom.streaming import resolve, state

MS = timedelta(milliseconds=1)


def arrive(path, rows):
    rows.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def test_machine_equals_the_fold_and_survives_a_restart(spark, folder):
    rows = [
        event(5, "completed", job_id="a", finished_at=T0 + 5 * MS, started_at=T0, tags=["x"]), event(2, "active", job_id="a"),
        event(7, "active", job_id="a"), event(1, "waiting", job_id="b", tags=["y"]), event(8, "failed", job_id="a", error_message="no"),
        event(9, "waiting", job_id="b"), event(3, "delayed", job_id="b"), event(5, "completed", job_id="a", finished_at=T0 + 5 * MS, started_at=T0, tags=["x"]),
    ]
    schema, source, table = events(spark, rows).schema, f"{folder}/in", f"{folder}/runs"
    for some in (rows[:3], rows[3:6], rows[6:7], rows[7:]):
        arrive(source, events(spark, some))
        state.read_through(state.ingest_states(stream(spark, source, schema), table, folder, f"{folder}/cp", keep=timedelta(days=1)))
    stored, expected = tables.read_table(spark, table), up.fold(events(spark, rows))
    order = [c for c in sorted(expected.columns)]
    assert sorted(map(str, stored.select(order).collect())) == sorted(map(str, expected.select(order).collect()))
    # The last two files change nothing, so they are announced to no one.
    assert spark.read.parquet(f"{folder}/changes").groupBy("batch_id").count().count() <= 2


def test_state_is_dropped_after_its_time(spark, folder):
    schema, source, out = events(spark, []).schema, f"{folder}/in", []
    for seq, status in ((5, "completed"), (6, "active")):
        arrive(source, events(spark, [event(seq, status)]))
        with state.rocksdb(spark):
            changed = state.run_states(stream(spark, source, schema), keep=timedelta(seconds=1))
            query = changed.writeStream.foreachBatch(lambda rows, _: out.extend(r.status for r in rows.collect())).outputMode(
                "update").option("checkpointLocation", f"{folder}/cp").start()
        state.read_through(query)
        time.sleep(2)
    # Nothing is known of the run any more, so nothing holds its status.
    assert out == ["completed", "active"]


def test_feed_sends_one_notice_a_second_and_always_the_last(spark, folder):
    schema = "kind string, id string, status string, number long"
    rows = [("run", "a", "waiting", 1), ("run", "b", "waiting", 1), ("run", "a", "active", 2), ("run", "a", "completed", 3), ("run", "a", "late", 0)]
    for row in rows:
        arrive(f"{folder}/in", spark.createDataFrame([row], schema))
    with state.rocksdb(spark):
        feed = state.coalesced_feed(stream(spark, f"{folder}/in", schema), "number", interval=timedelta(seconds=2))
        sent = []
        query = feed.writeStream.foreachBatch(lambda rows, _: sent.extend(rows.collect())).outputMode("update").option(
            "checkpointLocation", f"{folder}/cp").start()
    state.read_through(query, quiet=12)
    of_a = sorted((r for r in sent if r.id == "a"), key=lambda r: r.sent_at)
    assert sum(r.merged for r in of_a) == 4
    assert "completed" in {r.status for r in of_a}
    assert all(b.sent_at - a.sent_at >= timedelta(seconds=2) for a, b in zip(of_a, of_a[1:]))
    assert [(r.status, r.merged) for r in sent if r.id == "b"] == [("waiting", 1)]


def test_machine_leaves_no_old_rows_on_disk(spark, folder):
    """Neither the changes of a trigger that are announced by then, nor the files of its shuffles."""
    shared = os.path.dirname(shared_dir(spark, "any")).removeprefix("file:")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name.split("/shuffle_")[1].split("_")[0] for name in blocks.getAllFiles().mkString(",").split(",") if "/shuffle_" in name}
    before, written = set(glob.glob(f"{shared}/*")), shuffles()
    schema = events(spark, []).schema
    for seq in range(4):
        arrive(f"{folder}/in", events(spark, [event(seq, "active", job_id=f"{k}", data=f"{seq}") for k in range(50)]))
    state.read_through(state.ingest_states(
        stream(spark, f"{folder}/in", schema), f"{folder}/runs", folder, f"{folder}/cp", keep=timedelta(days=1)))
    assert spark.read.parquet(f"{folder}/changes").count() == 200
    assert not set(glob.glob(f"{shared}/*")) - before
    # Those of the empty trigger it was stopped in may be left; four triggers with rows have three each.
    assert len(shuffles() - written) <= 3


def test_settings_hold_inside_only(spark):
    (key,) = FREED
    with settings(spark, {**FREED, "runloom.test": "1"}):
        assert (spark.conf.get(key), spark.conf.get("runloom.test")) == ("true", "1")
    assert (spark.conf.get(key), spark.conf.get("runloom.test", None)) == ("false", None)


def test_a_long_trigger_is_not_stuck_while_its_tasks_end(spark, monkeypatch):
    class Query:
        isActive, lastProgress, stopped = True, None, False

        def stop(self):
            self.stopped = True

        def exception(self):
            return None

    done, query = [0], Query()

    def tasks():
        done[0] += 1
        query.isActive = done[0] < 10
        return done[0]

    monkeypatch.setattr(state, "_tasks_done", tasks)
    state.read_through(query, at_most=0.25)
    assert done[0] == 10
    query.isActive = True
    monkeypatch.setattr(state, "_tasks_done", lambda: 10)
    with pytest.raises(TimeoutError):
        state.read_through(query, at_most=0.25)


def line(job, at, seq=0):
    return ("q", job, at, at, seq, "log", "m")


LINE = "queue string, job_id string, job_timestamp timestamp_ntz, log_timestamp timestamp_ntz, log_seq int, level string, message string"
RUN = "queue string, job_id string, enqueued_at timestamp_ntz, id string"


def test_lines_and_runs_meet_in_either_order(spark, folder):
    hour = timedelta(hours=1)
    lines = [[line("first", T0), line("first", T0), line("never", T0)], [line("second", T0 + hour, 1)], [line("first", T0)], [line("end", T0 + 50 * hour)]]
    known = [[("q", "second", T0 + hour, "2")], [("q", "first", T0, "1"), ("q", "first", T0, "1")], [("q", "first", T0, "1")], [("q", "x", T0 + 50 * hour, "3")]]
    for some, runs in zip(lines, known):
        arrive(f"{folder}/lines", spark.createDataFrame(some, LINE))
        arrive(f"{folder}/runs", spark.createDataFrame(runs, RUN))
    resolve.ingest_resolved(
        stream(spark, f"{folder}/lines", LINE), stream(spark, f"{folder}/runs", RUN), f"{folder}/out", f"{folder}/cp", "10 hours").awaitTermination()
    logs = spark.read.parquet(f"{folder}/out/logs")
    assert sorted((r.job_run_id, r.log_seq) for r in logs.collect()) == [("1", 0), ("2", 1)]
    assert [r.job_id for r in spark.read.parquet(f"{folder}/out/unresolved").collect()] == ["never"]
    assert logs.filter(F.col("id").isNull()).count() == 0
    # What waits lies on disk, one store for both sides of the join, and not in the heap.
    assert glob.glob(f"{folder}/cp/state/0/0/*.zip")
    assert not glob.glob(f"{folder}/cp/state/*/*/*.delta") + glob.glob(f"{folder}/cp/state/0/0/left*")


class Store:
    """A value state and its timers, which count the calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, set()

    def getValueState(self, *_):
        return self if self.value is None and not self.calls else Store()

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)


class At:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_runs_of_a_pack_share_calls_and_each_has_its_own_time(spark):
    store, machine = Store(), state.RunMachine(10 * MS)
    machine.init(store)
    events_of = lambda ids, seq, status, final=False: iter([(0, i, seq, status, final, ["t"], f"{seq}") for i in ids])
    assert len(list(machine.handleInputRows((0,), events_of(range(500), 1, "completed", True), At(0)))) == 500
    assert store.calls == 2
    assert list(machine.handleInputRows((0,), events_of(range(500), 1, "completed", True), At(5))) == []
    late = list(machine.handleInputRows((0,), events_of([7], 2, "active"), At(9)))
    assert [(r.id, r.status, r.body) for r in late] == [(7, "completed", "2")]
    # At 12 all runs but the seventh are forgotten, also the one whose repeated event changed nothing.
    after = list(machine.handleInputRows((0,), events_of([7, 8], 3, "active"), At(12)))
    assert [(r.id, r.status) for r in after] == [(7, "completed"), (8, "active")]
    assert list(store.value[0]) == [7, 8]


def test_keys_of_a_feed_pack_wait_for_their_own_time():
    class Handle(Store):
        def getValueState(self, name, *_):
            setattr(self, name, Store())
            getattr(self, name).clear = lambda: getattr(self, name).update(None)
            return getattr(self, name)

    handle, feed = Handle(), state.Coalescer(10)
    feed.init(handle)
    notices = lambda ids, number: iter([(0, "run", i, number, f"{number}") for i in ids])
    ids = lambda rows: [(r.id, r.body, r.merged) for r in rows]
    assert len(ids(feed.handleInputRows((0,), notices(range(500), 1), At(0)))) == 500
    assert handle.sent.calls + handle.waiting.calls <= 4
    assert ids(feed.handleInputRows((0,), notices(["x"], 1), At(5))) == [("x", "1", 1)]
    assert ids(feed.handleInputRows((0,), notices([3, "x"], 2), At(6))) == []
    assert ids(feed.handleInputRows((0,), notices([3], 4), At(7))) == ids(feed.handleInputRows((0,), notices([3], 3), At(8))) == []
    assert handle.timers == {10, 15}
    assert ids(feed.handleExpiredTimer((0,), At(10), None)) == [(3, "4", 3)]
    assert ids(feed.handleInputRows((0,), notices([3, 4], 5), At(12))) == [(4, "5", 1)]
    assert handle.timers == {10, 15, 20}
    assert ids(feed.handleExpiredTimer((0,), At(15), None)) == [("x", "2", 1)]
    assert ids(feed.handleExpiredTimer((0,), At(20), None)) == [(3, "5", 1)]
