"""One key that holds a third of all rows."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from rows import T0, run, runs
from runloom.operators import logs as lg
from runloom.schemas import JOB_LOGS

# Sizes at which AQE takes a partition for skewed, scaled down to the test.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def lines(spark):
    """30 000 log lines of 200 jobs, a third of them of one job."""
    number = F.col("id")
    job = F.when(number % 3 == 0, F.lit(0)).otherwise(number % 200)
    return spark.range(0, 30_000, 1, 8).select(
        F.lit("q1").alias("queue"), job.cast("string").alias("job_id"), F.lit(T0).cast("timestamp_ntz").alias("job_timestamp"),
        F.lit(T0).cast("timestamp_ntz").alias("log_timestamp"), number.cast("int").alias("log_seq"), F.lit("log").alias("level"),
        F.sha2(number.cast("string"), 256).alias("message"), number.alias("seq"),
    )


def test_a_hot_job_is_split_when_lines_meet_runs(spark, lines):
    known = runs(spark, [run(str(i)) for i in range(200)])
    with settings(spark, SMALL):
        attached = lg.attach_runs(lines, known)
        rows = attached.collect()
        plan = attached._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 30_000 and all(r.job_run_id == f"q1/{r.job_id}" for r in rows)
    assert "SortMergeJoin(skew=true)" in plan


def test_a_hot_run_is_split_in_the_timeline(spark, lines):
    known = runs(spark, [run(str(i)) for i in range(200)])
    logs = lines.select(F.col("seq").cast("string").alias("id"), F.concat(F.lit("q1/"), "job_id").alias("job_run_id"), "level",
                        "message", F.col("log_timestamp").alias("ts"), "log_seq").select(*JOB_LOGS.names)
    with settings(spark, SMALL):
        drawn = lg.timeline(logs, known, T0)
        assert len(drawn.collect()) == 30_000
        assert "skew=true" in drawn._jdf.queryExecution().executedPlan().toString()


def test_numbering_a_hot_group_ranks_bounded_blocks(spark, lines):
    numbered = lg.number_lines(lines.drop("log_seq"), block=500)
    hot = numbered.filter("job_id = '0'").agg(F.count(F.lit(1)).alias("n"), F.max("log_seq").alias("last"),
                                              F.count_distinct("log_seq").alias("distinct")).first()
    assert hot.last == hot.n - 1 == hot.distinct - 1
