"""Streams with a state of their own for every key: the run machine and the coalesced feed.

Both use value state in RocksDB, so what is remembered lies on the executors'
disks and in the checkpoint, not in their heaps. Payloads travel as one column of
canonical JSON that is written and read by built-in functions; the Python side
sees numbers and statuses only.

Every call from Python to the state store is a round trip, which costs more than
the work on an event. So keys share packs: a trigger reads and writes a pack once,
and in it each key has a state and a time of its own.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from datetime import timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from runloom.functions.status import is_terminal
from runloom.functions.text import run_id
from runloom.operators.upsert import change_feed, complete
from runloom.schemas import RUN_KEY, RUN_VALUES
from runloom.session import FREED, settings, shared_dir
from runloom.sources.tables import delete, upsert_table, write_batch

_STORE = "spark.sql.streaming.stateStore"
# A restart needs the last state only, so older versions are dropped.
_ROCKSDB = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.minBatchesToRetain": "2",
    # It lies on disk twice, on the executors and in the checkpoint.
    f"{_STORE}.rocksdb.compression": "zstd",
    f"{_STORE}.rocksdb.blockSizeKB": "16",
    f"{_STORE}.rocksdb.compactOnCommit": "true",
    # Else every write reads first, to count keys for the progress reports.
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
    **FREED,
}
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
_MILLIS = timedelta(milliseconds=1)
# Runs of one hour of creation lie in so many packs, and the keys of a feed in so many.
_RUN_PACKS, _FEED_PACKS = 32, 1024


def rocksdb(spark: SparkSession, more: dict[str, str] = {}):
    """Queries started inside keep their state in RocksDB; a query holds on to the settings it started with."""
    return settings(spark, {**_ROCKSDB, **more})


def _tasks_done() -> list[tuple[int, int]]:
    """The stages at work, each with the number of its tasks that have ended."""
    tracker = SparkSession.active().sparkContext.statusTracker()
    stages = {stage: tracker.getStageInfo(stage) for stage in tracker.getActiveStageIds()}
    return sorted((stage, info.numCompletedTasks) for stage, info in stages.items() if info is not None)


def read_through(query: StreamingQuery, quiet: int = 2, at_most: float = 900) -> None:
    """Wait until some triggers in a row had no input, then stop.

    A query with timers or expiring state goes on for ever, so it has no end of
    its own to wait for. One trigger says nothing: a restarted query begins by
    repeating the one it was stopped in. A query is stuck when for ``at_most``
    seconds no trigger and no task ends, however long a trigger takes.
    """
    last, idle, end, done = None, 0, time.monotonic() + at_most, None
    quiet = max(2, quiet)
    while query.isActive and idle < quiet:
        if (now := _tasks_done()) != done:
            done, end = now, time.monotonic() + at_most
        if time.monotonic() > end:
            query.stop()
            raise TimeoutError("the stream did not come to rest")
        progress = query.lastProgress
        if progress is not None and progress["batchId"] != last:
            last, end = progress["batchId"], time.monotonic() + at_most
            idle = idle + 1 if progress["numInputRows"] == 0 else 0
        time.sleep(0.1)
    if query.exception() is not None:
        raise query.exception()
    query.stop()


def _unless_empty(handle):
    """Leave out triggers that changed nothing, of which a query with timers has very many.

    The whole batch is computed once, as every task has state to commit, and kept
    for a handler that reads it more than once.
    """

    def handled(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if rows.count():
                handle(rows, batch_id)
        finally:
            rows.unpersist()

    return handled


class RunMachine(StatefulProcessor):
    """What a run has come to: a terminal status stays, tags stay until others come, all else is the last event's.

    Every part of the state carries the arrival number it came with, so events
    may be delivered in any order within a trigger, or twice. A run is forgotten
    ``keep`` after the last event that changed its state, a pack with its last run.
    """

    def __init__(self, keep: timedelta | None):
        self.keep = None if keep is None else keep // _MILLIS

    def init(self, handle) -> None:
        self.pack = handle.getValueState(
            "pack", "id array<string>, at array<long>, last array<long>, status array<string>, body array<string>, ended array<long>,"
            " terminal array<string>, tagged array<long>, tags array<array<string>>", self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        runs = {run: (at, state) for run, at, *state in zip(*(self.pack.get() or ()))
                if self.keep is None or at + self.keep > now}
        fresh = {}
        for _, run, seq, status, final, tags, body in rows:
            state = fresh.get(run)
            if state is None:
                state = fresh[run] = list(runs[run][1]) if run in runs else [-1, None, None, -1, None, -1, []]
            if seq > state[0]:
                state[:3] = seq, status, body
            if final and seq > state[3]:
                state[3:5] = seq, status
            if tags and seq > state[5]:
                state[5:] = seq, list(tags)
        changed = {run: state for run, state in fresh.items() if run not in runs or state != runs[run][1]}
        if not changed:
            return
        before = {run: self._shown(runs[run][1]) for run in changed if run in runs}
        runs.update({run: (now, state) for run, state in changed.items()})
        self.pack.update(tuple(map(list, zip(*((run, at, *state) for run, (at, state) in runs.items())))))
        for run, state in changed.items():
            shown = self._shown(state)
            if shown != before.get(run):
                yield Row(id=run, status=shown[0], tags=shown[2], body=shown[1])

    @staticmethod
    def _shown(state: list) -> tuple:
        _, status, body, _, terminal, _, tags = state
        return terminal or status, body, tags

    def close(self) -> None:
        pass


def run_states(events: DataFrame, keep: timedelta | None = None) -> DataFrame:
    """A stream of job events as a stream of runs, each time one has changed.

    The state of a run is dropped ``keep`` after its last event, in processing
    time; with the retention it holds what the stored table holds. Events that
    come later start a new state, so they pass a retention filter first. A pack
    holds runs of one hour, so it stays as small as that hour is, however many
    runs there are.
    """
    keys = events.select(*RUN_KEY, *RUN_VALUES)
    body = F.to_json(F.struct(*RUN_KEY, *RUN_VALUES), _TIMES)
    pack = F.xxhash64(F.date_trunc("hour", "enqueued_at"), F.pmod(F.crc32(run_id()), F.lit(_RUN_PACKS)))
    slim = events.select(
        pack.alias("pack"), run_id().alias("id"), "seq", "status", F.coalesce(is_terminal(F.col("status")), F.lit(False)).alias("final"), "tags",
        body.alias("body"))
    changed = slim.groupBy("pack").transformWithState(
        RunMachine(keep), "id string, status string, tags array<string>, body string", "Update", "ProcessingTime")
    fields = changed.withColumn("body", F.from_json("body", keys.schema, _TIMES))
    return complete(fields.select(
        *[F.col(f"body.{c}").alias(c) for c in RUN_KEY], "status", "tags", *[F.col(f"body.{c}").alias(c) for c in RUN_VALUES]))


def ingest_states(events: DataFrame, table: str, path: str, checkpoint: str, keep: timedelta | None = None) -> StreamingQuery:
    """Keep a runs table from a stream of parsed job events, with the state of each run beside it.

    A trigger writes only the runs it has changed. They are merged into
    ``table``, and what that changed goes to ``path/changes`` for the feed. A
    trigger that runs again merges the same rows, which changes nothing. State
    and table agree, so no trigger folds what earlier ones stored.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        changes = shared_dir(batch.sparkSession, "changes")
        write_batch(change_feed(upsert_table(table, batch, changes=changes)), f"{path}/changes", batch_id)
        delete(batch.sparkSession, changes)

    handle = _unless_empty(handle)
    with rocksdb(events.sparkSession):
        return run_states(events, keep).writeStream.foreachBatch(handle).outputMode("update").option(
            "checkpointLocation", checkpoint).start()


class Coalescer(StatefulProcessor):
    """At most one message per key and interval, the latest: at once after a pause, else when the interval is over.

    Whatever of a pack waits has a timer for the moment it is due.
    """

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle) -> None:
        self.handle = handle
        # What was sent long ago holds nothing back and may be forgotten; what waits may not.
        self.sent = handle.getValueState("sent", "kind array<string>, id array<string>, at array<long>", 60 * self.interval)
        self.waiting = handle.getValueState(
            "waiting", "kind array<string>, id array<string>, due array<long>, number array<long>, body array<string>, merged array<long>")

    def _open(self, now: int) -> tuple[dict, dict]:
        """When the messages were sent that still hold others back, and what waits: due, number, body, merged."""
        sent = {(kind, id): at for kind, id, at in zip(*(self.sent.get() or ())) if now - at < self.interval}
        return sent, {(kind, id): held for kind, id, *held in zip(*(self.waiting.get() or ()))}

    def _close(self, now: int, sent: dict, waiting: dict, out: list) -> None:
        sent.update({key: now for key, *_ in out})
        if out:
            self.sent.update(tuple(map(list, zip(*((*key, at) for key, at in sent.items())))))
        if waiting:
            self.waiting.update(tuple(map(list, zip(*((*key, *held) for key, held in waiting.items())))))
        else:
            self.waiting.clear()

    @staticmethod
    def _sent(now: int, out: list) -> Iterator[Row]:
        for (kind, id), body, merged in out:
            yield Row(kind=kind, id=id, body=body, merged=merged, sent_at=now)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        sent, waiting = self._open(now)
        timers = {held[0] for held in waiting.values()}
        fresh = {}
        for _, kind, id, number, body in rows:
            held = waiting.get((kind, id)) or fresh.setdefault((kind, id), [None, -1, None, 0])
            held[3] += 1
            if number >= held[1]:
                held[1:3] = number, body
        out = []
        for message, held in fresh.items():
            if message in sent:
                held[0] = sent[message] + self.interval
                waiting[message] = held
            else:
                out.append((message, *held[2:]))
        for due in {held[0] for held in waiting.values()} - timers:
            self.handle.registerTimer(due)
        self._close(now, sent, waiting, out)
        yield from self._sent(now, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        sent, waiting = self._open(now)
        out = [(message, *held[2:]) for message, held in waiting.items() if held[0] <= now]
        for message, *_ in out:
            del waiting[message]
        if out:
            self._close(now, sent, waiting, out)
        yield from self._sent(now, out)

    def close(self) -> None:
        pass


def coalesced_feed(messages: DataFrame, number: str, interval: timedelta = timedelta(seconds=1)) -> DataFrame:
    """A stream of messages (kind, id, and others) thinned out by the clock: kind, id, others, merged, sent_at.

    ``number`` orders the messages of a key. ``merged`` says how many a notice
    stands for, ``sent_at`` when it was let through. Nothing is lost: the latest
    message of a key always comes, at the latest after ``interval``.
    """
    rest = [c for c in messages.columns if c not in ("kind", "id")]
    schema = messages.select(*rest).schema
    pack = F.pmod(F.xxhash64("kind", "id"), F.lit(_FEED_PACKS))
    slim = messages.select(pack.alias("pack"), "kind", "id", F.col(number).cast("long").alias("number"), F.to_json(F.struct(*rest), _TIMES).alias("body"))
    sent = slim.groupBy("pack").transformWithState(
        Coalescer(interval // _MILLIS), "kind string, id string, body string, merged long, sent_at long", "Update", "ProcessingTime")
    opened = sent.withColumn("body", F.from_json("body", schema, _TIMES))
    return opened.select(
        "kind", "id", *[F.col(f"body.{c}").alias(c) for c in rest], "merged", F.timestamp_millis("sent_at").alias("sent_at"))


def upsert_feed(spark: SparkSession, path: str, out: str, checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Announce the runs that ingestion changes (``path/changes``), each at most once a second, as batches under ``out``."""
    reader = spark.readStream.schema("id string, status string, batch_id long")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    changes = reader.parquet(f"{path}/changes").select(F.lit("run").alias("kind"), "id", "status", "batch_id")
    with rocksdb(spark):
        handle = _unless_empty(lambda rows, batch_id: write_batch(rows.withColumnRenamed("batch_id", "changed_in"), out, batch_id))
        return coalesced_feed(changes, "batch_id").writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", checkpoint).start()


# The processors travel with the plan, so executors need no copy of this module on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
