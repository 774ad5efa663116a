"""Job-queue tables derived from the ``events`` table of a data folder.

One event row stands for one job. Nothing is left out: every row gives a run,
and each run gives the stream messages and log lines its status implies. The
expressions are Spark SQL text so that they can be read next to the checks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.functions.text import canonical_json, log_id, run_id, uuid_of
from runloom.functions.time import duration_ms, ts
from runloom.schemas import RUN_VALUES
from runloom.session import configure, spread

# The instant at which every registered question is asked.
AS_OF = datetime(2024, 1, 31)

# Events whose messages one task makes and one file holds.
EVENTS_PER_TASK = 250_000

_WAIT = "((event_id * 37) % 5000)"
_RUN = "cast(floor(value * 100) as bigint)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared base: one job per event, with its times in milliseconds."""
    return jobs_of(_events(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/events.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Over how many files the messages of the events are dealt; only footers are read for it."""
    return max(1, -(-_events(spark, sf_dir).count() // EVENTS_PER_TASK))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Over how many tasks: all there are, and more where one would have too many events."""
    return max(spark.sparkContext.defaultParallelism, parts(spark, sf_dir))


def jobs_of(events: DataFrame) -> DataFrame:
    """The same base from a frame or stream of events."""
    base = events.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "cast(event_id as string) as job_id",
        "'q' || cast(user_id % 12 as string) as queue",
        "event_type as name",
        """case event_type when 'error' then 'failed' when 'view' then 'active'
             when 'click' then 'waiting' else 'completed' end as status""",
        "cast(event_id % 3 as smallint) as attempt",
        "cast(3 as smallint) as max_attempts",
        "case when user_id % 5 = 0 then cast(user_id % 10 as int) end as priority",
        "cast((event_id % 4) * 250 as int) as delay_ms",
        """case when event_id % 2 = 0 then '{"delay":1000,"type":"fixed"}' end as backoff""",
        "case when user_id % 11 = 0 then 'repeat:' || cast(user_id as string) end as repeat_job_key",
        "case when event_id % 13 = 0 then cast(event_id - 1 as string) end as parent_job_id",
        "'w' || cast(user_id % 9 as string) as worker_id",
        """case when user_id % 7 = 0 then cast(array() as array<string>)
             else array(event_type, 'seg' || cast(user_id % 5 as string)) end as tags""",
        "props as data",
        "case when event_type in ('signup', 'purchase') then '{\"status\":\"done\"}' end as result",
        "case when event_type = 'error' then 'boom ' || cast(user_id as string) end as error_message",
        "cast(date_trunc('millisecond', ts) as timestamp_ntz) as created_at",
        f"case when event_type <> 'click' then {_WAIT} end as _wait",
        f"case when event_type in ('error', 'signup', 'purchase') then {_WAIT} + {_RUN} end as _end",
    )
    return base.selectExpr(
        "* except (_wait, _end)",
        "created_at as enqueued_at",
        "timestampadd(MILLISECOND, _wait, created_at) as started_at",
        "timestampadd(MILLISECOND, _end, created_at) as finished_at",
        "unix_millis(cast(created_at as timestamp)) as _created_ms",
        "_wait",
        "_end",
    )


def runs_of(base: DataFrame) -> DataFrame:
    """Job runs as they stand once every message has arrived."""
    stack = F.when(F.col("error_message").isNotNull(), F.concat("error_message", F.lit("\n    at work")))
    rows = base.withColumns({
        "data": canonical_json(F.col("data")),
        "error_stack": stack,
        "duration_ms": duration_ms(),
        "id": run_id(),
    })
    return rows.select("id", "job_id", "queue", "enqueued_at", "status", "tags", *RUN_VALUES, "duration_ms")


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(jobs(spark, sf_dir))


def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queues that have jobs and two idle ones."""
    used = jobs(spark, sf_dir).select("queue").distinct()
    idle = spark.sql("select explode(array('q90', 'q91')) as queue")
    number = F.expr("cast(substring(queue, 2) as int)")
    return used.union(idle).select(
        uuid_of(F.col("queue")).alias("id"),
        F.col("queue").alias("name"),
        F.lit('{"attempts":3}').alias("default_job_options"),
        (number % 4 == 0).alias("is_paused"),
        ts(datetime(2023, 12, 31)).alias("created_at"),
    )


def schedulers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scheduler per even queue and a second one for the third queue."""
    number = F.expr("cast(substring(name, 2) as int)")
    even = queues(spark, sf_dir).filter(number % 2 == 0)
    copies = F.when(F.col("name") == "q2", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = even.select("id", "name", number.alias("_no"), F.explode(copies).alias("_copy"))
    key = F.concat(F.lit("s-"), F.col("name"), F.lit("-"), F.col("_copy").cast("string"))
    by_pattern = (F.col("_no") / 2 + F.col("_copy")) % 2 == 0
    return rows.select(
        uuid_of(key).alias("id"),
        F.col("id").alias("queue_id"),
        key.alias("key"),
        F.concat(F.lit("nightly "), F.col("name")).alias("name"),
        F.lit(None).cast("int").alias("limit"),
        F.lit(None).cast("timestamp_ntz").alias("end_date"),
        F.lit("UTC").alias("tz"),
        F.when(by_pattern, F.lit("0 3 * * *")).alias("pattern"),
        F.when(~by_pattern, (F.col("_no") * 1000).cast("int")).alias("every"),
        F.lit('{"name":"nightly"}').alias("template"),
        ts(datetime(2023, 12, 31)).alias("created_at"),
    )


# What is wrong with a message, by job number: one class of defect each.
_DEFECT = "event_id % 97"
# Every tenth job has its messages delivered twice.
_COPIES = "case when event_id % 10 = 3 then array(0, 1) else array(0) end"

_PAYLOAD = """
  case when bad = 7 then cast(null as string) else
  '{"version":' || case when bad = 2 then '2' else '1' end
  || ',"workerId":"' || worker_id || '"'
  || case when bad = 3 then '' else ',"queueName":"' || queue || '"' end
  || ',"phase":"' || phase || '"'
  || case when bad = 6 then ',"state":"paused"' when phase = 'terminal' then '' else ',"state":"' || phase || '"' end
  || case when bad = 5 then ',"tags":null' when phase = 'waiting' then ''
          when user_id % 7 = 0 then ',"tags":[]'
          else ',"tags":["' || event_type || '","seg' || cast(user_id % 5 as string) || '"]' end
  || ',"job":{' || case when bad = 4 then '' else '"id":"' || job_id || '",' end
  || '"name":"' || name || '","timestamp":' || case when bad = 8 then '1e30' else cast(_created_ms as string) end
  || ',"attemptsMade":' || cast(attempt as string)
  || ',"opts":{"attempts":3,"delay":' || cast(delay_ms as string)
  || case when priority is null then '' else ',"priority":' || cast(priority as string) end
  || case when backoff is null then '' else ',"backoff":' || backoff end
  || case when parent_job_id is null then '' else ',"parent":{"id":"' || parent_job_id || '"}' end || '}'
  || case when repeat_job_key is null then '' else ',"repeatJobKey":"' || repeat_job_key || '"' end
  || ',"data":' || data
  || case when bad = 9 then ',"processedOn":1e17' when phase = 'waiting' then ''
          else ',"processedOn":' || cast(_created_ms + _wait as string) end
  || case when bad = 10 then ',"finishedOn":9000000000000000' when phase = 'terminal'
          then ',"finishedOn":' || cast(_created_ms + _end as string) else '' end
  || case when phase = 'terminal' and event_type = 'error'
          then ',"failedReason":"' || error_message || '","stacktrace":["' || error_message || '","    at work"]' else '' end
  || case when phase = 'terminal' and result is not null then ',"returnvalue":' || result else '' end
  || case when bad = 1 then '}' else '}}' end
  end
"""


# The lower 16 bits of a message's number, permuted, go in front of the others: unique for
# all event numbers below 2^59, without overflow.
_SEQ = "(number % 65536) * 40503 % 65536 * 70368744177664 + number div 65536"


def _arriving(copies: DataFrame, payload: str) -> DataFrame:
    rows = copies.selectExpr("event_id * 8 + no * 2 + copy as number", f"{payload} as payload")
    return rows.selectExpr(f"{_SEQ} as seq", "payload").selectExpr("seq", "shiftright(seq, 58) as batch_id", "payload")


def messages_of(base: DataFrame) -> DataFrame:
    """Job messages: one per phase a job reached, shuffled, some twice, some broken.

    ``seq`` is the arrival order (a permutation, hence unique) and ``batch_id``
    cuts it into sixteen batches.
    """
    phases = base.selectExpr(
        "*",
        f"{_DEFECT} as bad",
        "stack(3, 0, 'waiting', true, 1, 'active', _wait is not null, 2, 'terminal', _end is not null)"
        " as (no, phase, reached)",
    ).filter("reached")
    copies = phases.selectExpr("*", f"explode({_COPIES}) as copy")
    return _arriving(copies, _PAYLOAD)


def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(jobs_of(spread(_events(spark, sf_dir), tasks(spark, sf_dir))))


_LOG_PAYLOAD = """
  case when bad = 7 then cast(null as string) else
  '{"version":' || case when bad = 2 then '2' else '1' end
  || ',"workerId":"' || worker_id || '"'
  || case when bad = 3 then '' else ',"queueName":"' || queue || '"' end
  || ',"jobId":"' || log_job_id || '","jobTimestamp":' || case when bad = 8 then '-1e30' else cast(_created_ms as string) end
  || ',"logTimestamp":' || case when bad = 9 then '1e17' else cast(log_ms as string) end || ',"logSeq":' || cast(log_seq as string)
  || ',"level":"' || case when bad = 6 then 'fatal' else level end || '","message":"' || message || '"'
  || case when bad = 1 then '' else '}' end
  end
"""


def log_messages_of(base: DataFrame) -> DataFrame:
    """Log messages: one when a job starts and one when it ends.

    Every fiftieth job logs under an id that no run has.
    """
    lines = base.filter("_wait is not null").selectExpr(
        "*",
        f"{_DEFECT} as bad",
        "case when event_id % 50 = 7 then 'lost-' || job_id else job_id end as log_job_id",
        """stack(2, 0, _created_ms + _wait, 'log', 'Processing job ' || job_id,
             1, _created_ms + _end, case when event_type = 'error' then 'error' else 'log' end,
             case when event_type = 'error' then 'Job ' || job_id || ' failed intentionally'
                  else 'Job ' || job_id || ' processed' end) as (no, log_ms, level, message)""",
    ).filter("log_ms is not null")
    copies = lines.selectExpr(
        "*", "case when no = 1 and _end = _wait then 1 else 0 end as log_seq", f"explode({_COPIES}) as copy"
    )
    return _arriving(copies, _LOG_PAYLOAD)


def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_messages_of(jobs_of(spread(_events(spark, sf_dir), tasks(spark, sf_dir))))


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored log lines of the runs."""
    return logs_of(job_runs(spark, sf_dir))


def logs_of(runs: DataFrame) -> DataFrame:
    lines = runs.filter("started_at is not null").selectExpr(
        "id as job_run_id",
        """stack(2, started_at, 'log', 'Processing job ' || job_id, 0,
             finished_at, case when status = 'failed' then 'error' else 'log' end,
             case when status = 'failed' then 'Job ' || job_id || ' failed intentionally'
                  else 'Job ' || job_id || ' processed' end,
             case when started_at = finished_at then 1 else 0 end) as (ts, level, message, log_seq)""",
    ).filter("ts is not null")
    return lines.select(log_id().alias("id"), "*")
