"""Message streams as Structured Streaming sources, and the command sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from runloom.sources.tables import file_names, path_of

MESSAGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("payload", T.StringType())])


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None, **options: str
) -> DataFrame:
    """Messages of a topic. Needs the Kafka connector on the class path.

    Offsets live in the checkpoint: what was not committed is read again. The
    order of a key's messages is that of its partition, so producers key by job
    and the topic keeps its number of partitions.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    raw = reader.options(**options).load()
    return raw.select(F.col("offset").alias("seq"), F.col("value").cast("string").alias("payload"))


def file_messages(spark: SparkSession, path: str, format: str = "json", max_files: int | None = None) -> DataFrame:
    """Messages that arrive as files of ``seq`` and ``payload``."""
    reader = spark.readStream.format(format).schema(MESSAGE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def append_files(rows: DataFrame, path: str, files: int) -> None:
    """Append rows as just so many files, so that a stream that takes as many at a time stops between two appends.

    Tasks that have no rows leave no file; empty files make up for them.
    """
    spark = rows.sparkSession
    before = set(file_names(spark, path))
    rows.coalesce(files).write.mode("append").option("compression", "zstd").parquet(path)
    new = set(file_names(spark, path)) - before
    if len(new) < files:
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
        (empty,) = set(file_names(spark, path)) - before - new
        copy = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy
        for k in range(1, files - len(new)):
            (fs, source), (_, target) = path_of(spark, f"{path}/{empty}"), path_of(spark, f"{path}/{k}-{empty}")
            copy(fs, source, fs, target, False, spark.sparkContext._jsc.hadoopConfiguration())


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """One Parquet table of a data folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def publish(messages: DataFrame, target: str, servers: str | None = None) -> None:
    """Send keyed payloads to a topic, or append them to a folder as JSON lines."""
    if servers is not None:
        writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", target)
        writer.save()
    else:
        messages.write.mode("append").json(target)
