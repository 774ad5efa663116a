"""Streams over several files, their batch counterparts, and redelivery."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rows import T0, job_message
from runloom.operators import upsert as up
from runloom.plans import catalog, fixture as fx
from runloom.session import shared_dir
from runloom.sources.messages import parse_job_messages, parse_log_messages, valid_rows
from runloom.sources.streams import append_files, file_messages, kafka_messages, publish
from runloom.sources.tables import file_names, write_batch
from runloom.streaming import ingest, windows

EPOCH = 1704888000000


def drop(spark, path, payloads, start=0):
    """One more file of messages."""
    rows = [(start + i, p) for i, p in enumerate(payloads)]
    spark.createDataFrame(rows, "seq long, payload string").coalesce(1).write.mode("append").json(path)


@pytest.fixture
def shuffled(spark, smallest, folder):
    """All job messages of the smallest tables in eight files."""
    path = f"{folder}/in"
    messages = fx.job_messages(spark, smallest).select("seq", "payload")
    messages.repartition(8, "seq").write.json(path)
    return messages, path


def test_many_batches_equal_one_fold(spark, shuffled, folder):
    messages, path = shuffled
    ingest.ingest_jobs(file_messages(spark, path, max_files=2), f"{folder}/out", f"{folder}/cp", T0).awaitTermination()
    got = ingest.current_runs(spark, f"{folder}/out")
    batches = spark.read.parquet(f"{folder}/out/states").select("batch_id").distinct().count()
    assert batches == 4
    expected = up.fold(valid_rows(parse_job_messages(messages)))
    order = sorted(expected.columns)
    assert got.select(order).exceptAll(expected.select(order)).count() == 0
    assert expected.select(order).exceptAll(got.select(order)).count() == 0
    rejects = spark.read.parquet(f"{folder}/out/rejects")
    assert rejects.count() == parse_job_messages(messages).filter("reject_reason is not null").count()
    assert {"payload", "reject_reason"} <= set(rejects.columns)


def test_a_batch_delivered_again_leaves_no_second_copy(spark, folder):
    rows = up.fold_states(valid_rows(parse_job_messages(spark.createDataFrame([(1, job_message())], "seq long, payload string"))))
    for _ in range(2):
        write_batch(rows, f"{folder}/states", 7)
    assert spark.read.parquet(f"{folder}/states").count() == 1


def test_a_restarted_stream_goes_on_where_it_stopped(spark, folder):
    source, out, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/cp"
    start = lambda: ingest.ingest_jobs(file_messages(spark, source), out, checkpoint, T0).awaitTermination()
    drop(spark, source, [job_message(job__id="1"), job_message(job__id="2")])
    start()
    drop(spark, source, [job_message(job__id="1", state="completed", phase="terminal", job__finishedOn=EPOCH + 5)], start=2)
    start()
    # Late again: the terminal status stays.
    drop(spark, source, [job_message(job__id="1")], start=3)
    start()
    got = {r.job_id: r.status for r in ingest.current_runs(spark, out).collect()}
    assert got == {"1": "completed", "2": "active"}
    assert spark.read.parquet(f"{out}/states").count() == 4
    compacted = f"{folder}/compact"
    ingest.compact(ingest.stored_states(spark, out), compacted)
    assert {r.job_id: r.status for r in up.runs_of_states(spark.read.parquet(compacted)).collect()} == got


def test_last_in_batch_uses_the_batches_of_the_stream(spark, folder):
    done = job_message(state="completed", phase="terminal", job__finishedOn=EPOCH + 5)
    drop(spark, f"{folder}/one", [done, job_message()])
    for i, payload in enumerate([done, job_message()]):
        drop(spark, f"{folder}/two", [payload], start=i)
    status = {}
    for name, files in (("one", None), ("two", 1)):
        messages = file_messages(spark, f"{folder}/{name}", max_files=files)
        out = f"{folder}/out-{name}"
        ingest.ingest_jobs(messages, out, f"{out}/cp", T0, semantics="last_in_batch").awaitTermination()
        status[name] = ingest.current_runs(spark, out).first().status
    assert status == {"one": "active", "two": "completed"}


def test_events_beyond_retention_are_left_out(spark, folder):
    drop(spark, f"{folder}/in", [job_message(job__id="old", job__timestamp=EPOCH - 3_600_001), job_message(job__id="edge", job__timestamp=EPOCH - 3_600_000)])
    ingest.ingest_jobs(file_messages(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/cp", as_of=T0,
                       retention=timedelta(hours=1)).awaitTermination()
    assert [r.job_id for r in ingest.current_runs(spark, f"{folder}/out").collect()] == ["edge"]


def test_changes_of_a_batch(spark):
    stored = up.fold(valid_rows(parse_job_messages(spark.createDataFrame([(1, job_message(job__id="1"))], "seq long, payload string"))))
    batch = valid_rows(parse_job_messages(spark.createDataFrame(
        [(2, job_message(job__id="1")), (3, job_message(job__id="2"))], "seq long, payload string")))
    assert [r.status for r in ingest.changes_of_batch(stored, batch).collect()] == ["active"]


def test_log_stream_of_many_batches(spark, smallest, folder):
    messages = fx.log_messages(spark, smallest).select("seq", "payload")
    messages.repartition(6, "seq").write.json(f"{folder}/in")
    table = fx.job_runs(spark, smallest)
    ingest.ingest_logs(file_messages(spark, f"{folder}/in", max_files=2), lambda: table, f"{folder}/out", f"{folder}/cp", T0).awaitTermination()
    stored, waiting = ingest.current_logs(spark, f"{folder}/out"), ingest.current_buffer(spark, f"{folder}/out")
    lines = valid_rows(parse_log_messages(messages))
    identities = lines.select("queue", "job_id", "job_timestamp", "log_timestamp", "log_seq").distinct()
    assert stored.count() + waiting.count() == identities.count()
    assert waiting.filter(~F.col("job_id").startswith("lost-")).count() == 0
    assert stored.join(table.select(F.col("id").alias("job_run_id")), "job_run_id", "left_anti").count() == 0


def test_hourly_stream_of_many_batches(spark, smallest, folder):
    table = fx.job_runs(spark, smallest)
    table.repartition(5, "id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    stats = windows.hourly_stream(stream, "60 days", fx.AS_OF)
    windows.write_updates(stats, f"{folder}/out", f"{folder}/cp", T0).awaitTermination()
    from runloom.operators.rollup import hourly_rollup

    expected = hourly_rollup(table, fx.AS_OF)
    got = windows.current_hours(spark, f"{folder}/out").select(expected.columns)
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0


def test_changes_coalesce_to_one_per_second(spark):
    at = lambda ms: T0 + timedelta(milliseconds=ms)
    rows = [("run", "a", "waiting", at(1)), ("run", "a", "active", at(900)), ("run", "a", "failed", at(1000)),
            ("queue", "a", "x", at(2)), ("run", "b", "y", at(3))]
    changes = spark.createDataFrame(rows, "kind string, id string, status string, changed_at timestamp_ntz")
    got = sorted((r.kind, r.id, r.status, r.merged) for r in windows.coalesced(changes).collect())
    assert got == [("queue", "a", "x", 1), ("run", "a", "active", 2), ("run", "a", "failed", 1), ("run", "b", "y", 1)]


def test_published_commands_can_be_read_back(spark, folder):
    publish(spark.createDataFrame([("q", '{"name":"n"}')], "key string, value string"), f"{folder}/commands")
    assert spark.read.json(f"{folder}/commands").first().value == '{"name":"n"}'


def test_kafka_source_names_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_messages(spark, "localhost:1", "jobs", 300)


class _Session:
    """As much of a session as the shared folder asks for."""

    def __init__(self, named=None, master="local[2]"):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext, self.master, self.own = self, master, None

    def getCheckpointDir(self):
        return self.own

    def setCheckpointDir(self, folder):
        self.own = folder


def test_shared_folder_follows_the_session():
    named = _Session("hdfs://shared/", master="yarn")
    first, second = shared_dir(named, "x"), shared_dir(named, "x")
    assert first.startswith("hdfs://shared/x-") and first != second
    with pytest.raises(RuntimeError):
        shared_dir(_Session(master="yarn"), "x")
    local = _Session()
    assert shared_dir(local, "x").startswith(local.own)


def test_an_append_is_just_so_many_files(spark, folder):
    """Rows that few tasks hold, or none, still fill a trigger of their own."""
    rows = spark.createDataFrame([(k, str(k)) for k in range(6)], "seq long, payload string")
    for k, some in enumerate((rows.filter("seq < 3").repartition(1), rows.filter("seq > 9"), rows.filter("seq >= 3").repartition(8))):
        append_files(some, f"{folder}/in", 4)
        assert len(file_names(spark, f"{folder}/in")) == 4 * (k + 1)
    seen = []
    stream = file_messages(spark, f"{folder}/in", format="parquet", max_files=4)
    stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r.seq for r in batch.collect()))).option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[0, 1, 2], [], [3, 4, 5]]


def test_no_task_makes_the_messages_of_all_events(spark, folder, monkeypatch):
    """Files and tasks grow with the events; a quarter of the messages still arrives before the next."""
    monkeypatch.setattr(fx, "EVENTS_PER_TASK", 25)
    spark.range(64).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-03' + make_dt_interval(id % 28) as ts", "id as user_id",
        "element_at(array('error', 'view', 'click', 'signup'), cast(id % 4 as int) + 1) as event_type", "1.5d as value", "'{}' as props",
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    assert fx.parts(spark, folder) == 3
    for query, batch in (("stream_fold_batches", "fold_per_event"), ("stream_logs_joined", "logs_resolved")):
        result, expected = catalog.QUERIES[query](spark, folder), catalog.QUERIES[batch](spark, folder)
        rows = sorted(map(str, result.select(expected.columns).collect()))
        assert rows and rows == sorted(map(str, expected.collect()))
