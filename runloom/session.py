"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings of the contract. AQE splits skewed join partitions and
# coalesces small ones, so a hot queue or job does not end in one task.
CONTRACT = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Files of a shuffle go with the execution that wrote them, not when the driver's heap happens to be collected.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# The JVM never compiles methods beyond this many bytes, which generated code for parsing soon has;
# Spark then evaluates its expressions in smaller ones.
SMALL_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession) -> SparkSession:
    """Put the contract settings on an existing session."""
    for key, value in CONTRACT.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    # Static, so only a new session can have it: recording the call site of every
    # column costs more than the analysis of plans made of many small expressions.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings that hold inside only; a stream started there keeps them."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal an input over so many tasks, or leave it as its source splits it.

    For callers who know that the work on few bytes is much, such as parsing.
    """
    return df if partitions is None else df.repartition(partitions)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediate tables and stream checkpoints.

    It lies under ``spark.checkpoint.dir`` where the cluster names one, so that
    the data outlives any executor. Only a local session may fall back to a
    temporary folder of this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="runloom-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4()}"
