from datetime import timedelta

from rows import T0, run, runs
from runloom.operators import logs as lg
from runloom.schemas import JOB_LOGS
from runloom.sources import tables

DAY = timedelta(days=1)


def test_writing_runs_replaces_the_dates_that_occur(spark, folder):
    first = [run("1"), run("2", created_at=T0 + DAY)]
    tables.write_runs(runs(spark, first), folder)
    tables.write_runs(runs(spark, [run("3")]), folder)
    assert sorted(r.job_id for r in tables.read_table(spark, folder).collect()) == ["2", "3"]


def test_a_hot_date_is_written_by_many_tasks(spark, folder):
    from test_skew import SMALL, settings

    busy = [run(str(i), created_at=T0 if i % 3 else T0 + (i % 5) * DAY) for i in range(3000)]
    with settings(spark, SMALL):
        tables.write_runs(runs(spark, busy), folder)
    import os

    files = [f for f in os.listdir(f"{folder}/created_date={T0.date()}") if f.endswith(".parquet")]
    assert len(files) > 1
    assert tables.read_table(spark, folder).count() == 3000


def test_appending_logs_twice_stores_them_once(spark, folder):
    rows = [(str(i), "r", "log", "m", T0 + i * DAY, 0) for i in range(3)]
    logs = spark.createDataFrame(rows, JOB_LOGS)
    tables.write_logs(logs, folder)
    again = lg.not_yet_stored(logs, tables.read_table(spark, folder))
    tables.write_logs(again, folder)
    assert tables.read_table(spark, folder).count() == 3
