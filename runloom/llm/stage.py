"""Written intermediates and other things the text operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runloom.session import shared_dir


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so that other columns cannot clash.

    A row without an id cannot be referred to and is left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.filter(F.col("doc_id").isNotNull())


def staged(df: DataFrame, purpose: str, free: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor. What the
    written plan has shuffled is garbage from here on; with ``free`` the
    collector is asked to say so, because the cleaner removes shuffle files only
    after that.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for file in table.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def fold_of(id_col: str | Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo the folds."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
