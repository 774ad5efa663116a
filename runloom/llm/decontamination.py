"""Benchmark passages in documents, by a prefix-filtered set join.

A window of a benchmark item is a set of shingles (runs of up to three words)
with places. A document contains a window only if it contains every shingle of
it, so by the prefix principle for containment of all elements one shingle of
each window is enough to find every candidate: its rarest, as counted over all
documents. A candidate place must leave room for the window before and after
(positional and length bounds), and then the words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runloom.llm import tokens
from runloom.llm.stage import discard, staged

LENGTH, SHINGLE = 10, 3
APART = tokens.separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
# Windows looked for in one pass; more are taken in several passes.
AT_ONCE = 500_000


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words, shingle, offset) of each shingle of each window."""
    for batch in batches:
        for part in tokens.slices(batch.column(1)):
            w = tokens.words(part, APART, lower=True)
            for k, (first, end) in enumerate(zip(w.first[:-1], w.first[1:])):
                n = int(end - first)
                item = batch.column(0).slice(part.row + k, 1)
                length = min(n, LENGTH)
                for start in range(first, end - length + 1 if n else first):
                    run = w.hash[start : start + length]
                    grams = tokens.windows(run, min(SHINGLE, length)).view(np.int64)
                    yield pa.record_batch([
                        pa.concat_arrays([item] * len(grams)), tokens.lists(np.tile(run.view(np.int64), len(grams)), np.full(len(grams), length), pa.int64()),
                        pa.array(grams), pa.array(np.arange(len(grams)), pa.int32()),
                    ], names=["item_id", "window", "shingle", "offset"])


def _matches(wanted: np.ndarray, w: tokens.Words, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first words, shingles) of the shingles of the texts that are wanted."""
    counts = np.diff(w.first)
    left = np.repeat(w.first[1:], counts) - np.arange(len(w.hash))
    seen = np.zeros(1 << 16, bool)
    seen[wanted & np.uint64(0xFFFF)] = True
    for size in sizes:
        grams = tokens.windows(w.hash, size)
        at = np.flatnonzero(seen[grams & np.uint64(0xFFFF)] & (left[: len(grams)] >= size))
        at = at[np.isin(grams[at], wanted)]
        yield at, grams[at]


def _frequencies(wanted, sizes):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(wanted.value.view(np.uint64))
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in tokens.slices(batch.column(0)):
                for _, grams in _matches(known, tokens.words(part, APART, lower=True), sizes):
                    np.add.at(total, np.searchsorted(known, grams), 1)
        some = total > 0
        yield pa.record_batch([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["shingle", "n"])

    return counted


def _candidates(wanted, sizes):
    """Per document its word count and the places of wanted shingles, with the words around them."""
    reach = LENGTH - 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(wanted.value.view(np.uint64))
        for batch in batches:
            for part in tokens.slices(batch.column(1)):
                w = tokens.words(part, APART, lower=True)
                at, grams = (np.concatenate(x) for x in zip(*_matches(known, w, sizes)))
                owner = np.searchsorted(w.first, at, "right") - 1
                order = np.argsort(owner, kind="stable")
                at, grams, owner = at[order], grams[order], owner[order]
                before = np.minimum(at - w.first[owner], reach)
                length = np.minimum(w.first[owner + 1] - at, LENGTH) + before
                low = at - before
                around = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low, length)
                place = pa.StructArray.from_arrays([
                    pa.array(at - w.first[owner], pa.int64()), pa.array(before, pa.int32()), pa.array(grams.view(np.int64)),
                    tokens.lists(w.hash[around].view(np.int64), length, pa.int64()),
                ], names=["at", "before", "shingle", "around"])
                n = len(w.first) - 1
                cut = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=n))], pa.int32())
                yield pa.record_batch([
                    batch.column(0).slice(part.row, n), pa.array(np.diff(w.first), pa.int64()), pa.ListArray.from_arrays(cut, place),
                ], names=["doc_id", "n_words", "places"])

    return found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", at_once: int = AT_ONCE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, contaminated.

    A window is ``LENGTH`` consecutive words of an item, or the whole item if it
    has fewer words; an item without words has none. A document word inside any
    occurrence of a window is hit. ``items`` lists the items with occurring
    windows, sorted as strings, ``spans`` the hit words as merged (start, end)
    word positions. Null, empty and wordless texts have 0 words. Items of equal
    text each count, an item id that repeats counts once, and so does a document
    row that repeats in full; of several texts under one id, the hits are
    united. Rows without an id are left out; empty tables give no hits.

    The shingles of at most ``at_once`` windows are sent to every task; when
    items have more, windows are dealt into so many groups and the documents are
    read once for each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull())
    items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).filter(F.col("item_id").isNotNull())
    kinds = "item_id string, window array<long>, shingle long, offset int"
    shingles = staged(items.mapInArrow(_item_windows, kinds).distinct(), "windows")
    groups = max(1, -(-shingles.filter("offset = 0").count() // at_once))
    shingles = shingles.withColumn("group", F.pmod(F.xxhash64("window"), F.lit(groups)))
    rarest = Window.partitionBy("item_id", "window").orderBy(F.coalesce("n", F.lit(0)), "shingle", "offset")
    counted, hits = None, None
    for group in range(groups):
        own = shingles.filter(F.col("group") == group).drop("group")
        sizes = [x[0] for x in own.select(F.least(F.size("window"), F.lit(SHINGLE))).distinct().collect()] or [SHINGLE]

        def shared(df: DataFrame):
            return spark.sparkContext.broadcast(df.select("shingle").distinct().toPandas()["shingle"].to_numpy(np.int64))

        rates = docs.select("text").mapInArrow(_frequencies(shared(own), sizes), "shingle long, n long")
        rates = staged(rates.groupBy("shingle").agg(F.sum("n").alias("n")), "rates")
        prefix = own.join(rates, "shingle", "left").withColumn("rank", F.row_number().over(rarest)).filter("rank = 1")
        prefix = staged(prefix.select("item_id", "window", "shingle", "offset"), "prefix")
        found = docs.mapInArrow(
            _candidates(shared(prefix), sizes),
            "doc_id long, n_words long, places array<struct<at: long, before: int, shingle: long, around: array<long>>>",
        )
        found = staged(found, "candidates")
        if counted is None:
            counted = found.select("doc_id", "n_words")
        places = found.select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.*").join(prefix, "shingle")
        start = F.col("before") - F.col("offset")
        fits = (start >= 0) & (start + F.size("window") <= F.size("around"))
        same = F.when(fits, F.slice("around", start + 1, F.size("window"))) == F.col("window")
        hit = places.filter(same).select("doc_id", "item_id", (F.col("at") - F.col("offset")).alias("from"), F.size("window").alias("length"))
        hits = staged(hit.distinct() if hits is None else hit.union(hits).distinct(), "hits", free=True)
        discard(rates)
    # Word positions of a document that windows cover; a start that no earlier window reaches opens a span.
    to = F.col("from") + F.col("length")
    ordered = Window.partitionBy("doc_id").orderBy("from", "to")
    ends = hits.select("doc_id", "from", to.alias("to")).distinct()
    reached = ends.withColumn("before", F.max("to").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = reached.withColumn("n", F.sum(F.when(F.coalesce(F.col("from") > F.col("before"), F.lit(True)), 1).otherwise(0)).over(ordered))
    spans = fresh.groupBy("doc_id", "n").agg(F.min("from").alias("start"), F.max("to").alias("end"))
    spans = spans.groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = staged(spans.join(named, "doc_id"), "contaminated")
    return counted.distinct().join(found, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
