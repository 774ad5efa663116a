"""Substring search through a table of trigrams.

A text that contains a pattern contains every run of three characters of it. The
postings say which files have which trigrams in which columns, so a search opens
only the files that have all those of the pattern, and the usual predicate
decides on their rows. A file the postings do not know is always opened: an index
that lags behind its table costs time, never rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runloom.functions.text import contains_ci
from runloom.sources.tables import read_table
from runloom.sources.versions import Versioned

SIZE = 3
# The mark of a file that has been indexed.
_INDEXED = ""
# Parts of the stored postings; a lookup reads those of its trigrams.
SHARDS = 32


def _shard(trigram: Column) -> Column:
    return F.pmod(F.crc32(trigram), F.lit(SHARDS)).cast("int")


def _grams(column: Column) -> Column:
    text = F.lower(F.coalesce(column, F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (SIZE - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.substring(text, i, F.lit(SIZE)))
    return F.array_distinct(F.filter(grams, lambda g: F.length(g) == SIZE))


def postings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(trigram, file) of the files a frame reads, and a mark for each of the files.

    Trigrams are reduced to one row per file in each task before they move; the
    rows of a file are read by few tasks, so what moves is near the result.
    """
    # The mark comes first in every row's list, so a file of empty texts has it too.
    every = F.array_distinct(F.flatten(F.array(F.array(F.lit(_INDEXED)), *[_grams(F.col(c)) for c in columns])))
    named = rows.select(F.input_file_name().alias("file"), every.alias("grams"))
    found = named.select("file", F.explode("grams").alias("trigram")).distinct()
    return found.select("trigram", "file", _shard(F.col("trigram")).alias("shard"))


def write_postings(rows: DataFrame, columns: list[str], path: str) -> None:
    """Index the files of a frame as a whole, in the place of what was indexed before."""
    Versioned(rows.sparkSession, path, "shard").replace(postings(rows, columns), [str(k) for k in range(SHARDS)], ["trigram"])


def add_postings(rows: DataFrame, columns: list[str], path: str) -> None:
    """Index the files that a frame reads and the postings do not know; files that are gone leave."""
    spark, table = rows.sparkSession, Versioned(rows.sparkSession, path, "shard")
    seen = table.current()
    stored, now = table.read(at=seen), rows.inputFiles()
    known = {r["file"] for r in stored.filter(F.col("trigram") == _INDEXED).select("file").collect()}
    kept = stored.join(spark.createDataFrame([(f,) for f in now], "file string"), "file", "left_semi").select(*stored.columns)
    fresh = [f for f in now if f not in known]
    if fresh:
        kept = kept.unionByName(postings(spark.read.schema(rows.select(*columns).schema).parquet(*fresh), columns))
    table.replace(kept, list(seen.folders), ["trigram"], seen)


def trigrams_of(pattern: str) -> list[str]:
    """Trigrams that every text matching the pattern has; wildcards part its pieces."""
    pieces = re.split(r"[%_]", pattern.lower())
    if "\\" in pattern:  # an escape may make a wildcard a character
        return []
    return sorted({p[k : k + SIZE] for p in pieces for k in range(len(p) - SIZE + 1)})


def files_with(spark: SparkSession, path: str, pattern: str, files: list[str]) -> list[str]:
    """Those of the files that may hold the pattern.

    Names of files come to the driver, which has listed them anyway.
    """
    wanted = trigrams_of(pattern)
    if not wanted:
        return files
    table = Versioned(spark, path, "shard")
    rows = spark.createDataFrame([(t,) for t in [_INDEXED, *wanted]], "trigram string").select("trigram", _shard(F.col("trigram")).alias("shard"))
    shards = sorted({str(r["shard"]) for r in rows.collect()})  # one row per trigram of the pattern
    hits = table.read(shards).filter(F.col("trigram").isin([_INDEXED, *wanted]))
    short = hits.groupBy("file").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") <= len(wanted))
    without = {r["file"] for r in short.select("file").collect()}
    return [f for f in files if f not in without]


def search(spark: SparkSession, table: str, index: str, columns: list[str], pattern: str) -> DataFrame:
    """The rows of a stored table with the pattern in one of the columns, from the files that may hold it.

    The same rows as the predicate alone would give, whatever state the postings
    are in.
    """
    rows = read_table(spark, table)
    hit = reduce(lambda a, b: a | b, [contains_ci(F.col(c), pattern) for c in columns])
    files = rows.inputFiles()
    chosen = files_with(spark, index, pattern, files)
    if not chosen:
        return rows.filter(F.lit(False))
    if len(chosen) < len(files):
        rows = spark.read.schema(rows.schema).option("basePath", table).parquet(*chosen).select(*rows.columns)
    return rows.filter(hit)
