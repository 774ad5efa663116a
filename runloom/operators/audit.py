"""Checking that what was sent arrived: expected jobs against stored runs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runloom.functions.status import is_terminal

LOGS_PER_JOB = 2


def runs_of_test(runs: DataFrame, run_id: str) -> DataFrame:
    """Runs whose payload carries the id of a test run."""
    return runs.filter(F.get_json_object("data", "$.stress.runId") == run_id)


def compare(expected: DataFrame, runs: DataFrame, run_id: str, queue: str, name: str) -> DataFrame:
    """Each expected job next to its stored run, with what is wrong.

    ``expected`` has job_id, index, wait, should_fail and payload_length, one
    row per job. Of several runs of one job the latest counts.
    """
    field = lambda path: F.get_json_object("data", f"$.{path}")
    actual = runs_of_test(runs, run_id).select(
        "job_id", "created_at", "id", "queue", "name", "status",
        field("wait").try_cast("long").alias("wait"),
        (field("shouldFail") == "true").alias("should_fail"),
        field("stress.index").try_cast("long").alias("index"),
        F.coalesce(F.length(field("stress.payload")), F.lit(0)).alias("payload_length"),
    )
    values = ["queue", "name", "status", "wait", "should_fail", "index", "payload_length"]
    latest = actual.groupBy("job_id").agg(F.max_by(F.struct(*values), F.struct("created_at", "id")).alias("a"))
    both = expected.select("job_id", F.struct("index", "wait", "should_fail", "payload_length").alias("e")).join(
        latest, "job_id", "full_outer"
    )
    same = (
        (F.col("a.queue") == queue)
        & F.col("a.name").eqNullSafe(F.lit(name))
        & F.col("a.wait").eqNullSafe(F.col("e.wait").cast("long"))
        & F.col("a.should_fail").eqNullSafe(F.col("e.should_fail"))
        & F.col("a.index").eqNullSafe(F.col("e.index").cast("long"))
        & (F.col("a.payload_length") == F.col("e.payload_length"))
    )
    wanted, found = F.col("e").isNotNull(), F.col("a").isNotNull()
    pair = wanted & found
    return both.select(
        "job_id",
        wanted.alias("expected"),
        found.alias("found"),
        F.col("a.status").alias("status"),
        (wanted & ~found).alias("missing"),
        (pair & ~same).alias("payload_mismatch"),
        (pair & F.coalesce((F.col("a.status") == "failed") & ~F.col("e.should_fail"), F.lit(False))).alias("unexpected_failure"),
        (pair & F.coalesce((F.col("a.status") == "completed") & F.col("e.should_fail"), F.lit(False))).alias("missed_failure"),
        F.col("e.should_fail").alias("should_fail"),
    )


MISMATCHES = ["payload_mismatch", "unexpected_failure", "missed_failure"]


def mismatches(compared: DataFrame) -> DataFrame:
    """One row per mismatch; a job can have several."""
    reasons = F.array(*[F.when(F.col(m), F.lit(m)) for m in MISMATCHES])
    rows = compared.select("job_id", "status", F.explode(reasons).alias("reason"))
    return rows.filter(F.col("reason").isNotNull())


def log_count(logs: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """Log lines of the test's runs; lines are counted per run before the join."""
    per_run = logs.groupBy("job_run_id").agg(F.count(F.lit(1)).alias("_lines"))
    ids = runs_of_test(runs, run_id).select(F.col("id").alias("job_run_id"))
    return per_run.join(ids, "job_run_id").agg(F.coalesce(F.sum("_lines"), F.lit(0)).cast("long").alias("found_logs"))


def tallies(compared: DataFrame, logs: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """The audit as one row: what was expected, found, missing and wrong."""
    wanted = F.col("expected")
    flag = lambda c: c.cast("long")
    jobs = compared.agg(
        F.count_if(wanted).alias("expected_jobs"),
        F.count_if(F.col("found")).alias("found_jobs"),
        F.count_if(F.col("missing")).alias("missing_jobs"),
        F.count_if(wanted & F.col("should_fail")).alias("expected_failed"),
        F.count_if(wanted & ~F.col("should_fail")).alias("expected_completed"),
        F.count_if(wanted & (F.col("status") == "completed")).alias("completed"),
        F.count_if(wanted & (F.col("status") == "failed")).alias("failed"),
        F.count_if(wanted & is_terminal(F.col("status"))).alias("terminal"),
        F.coalesce(F.sum(sum((flag(F.col(m)) for m in MISMATCHES), F.lit(0).cast("long"))), F.lit(0)).cast("long").alias("mismatches"),
    )
    both = jobs.unionByName(log_count(logs, runs, run_id), allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    expected_logs = (F.col("expected_jobs") * LOGS_PER_JOB).alias("expected_logs")
    clean = (F.col("missing_jobs") == 0) & (F.col("mismatches") == 0)
    done = F.col("terminal") == F.col("expected_jobs")
    logged = F.col("found_logs") == F.col("expected_jobs") * LOGS_PER_JOB
    return row.select("*", expected_logs, (clean & done & logged).alias("verified"))
