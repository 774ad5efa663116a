"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that the stage before has kept and is written
before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.llm import decontamination, exact_dedup, language, near_dedup, packing
from runloom.llm.stage import staged, table

# The share of its main language that a document must have.
LEAST_SHARE = 0.5


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with one of the ids, in their own columns and once each."""
    chosen = ids.select(F.col("doc_id").alias("_chosen"))
    return docs.join(chosen, docs["doc_id"] == chosen["_chosen"], "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable main language.

    Null and letterless texts go, and mixtures without a language that has half
    of the text. What a language looks like is learned from the labelled
    documents at hand.
    """
    found = language.identify(docs, language.learn(docs))
    return _keep(docs, found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the longest as written, then the smallest id."""
    return _keep(docs, exact_dedup.exact_duplicates(docs).filter("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents keep the one with the smallest id."""
    return _keep(docs, near_dedup.near_duplicates(docs).filter("kept"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _keep(docs, found.filter("not contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

# Neither mixture inference nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name, free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
