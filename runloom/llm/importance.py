"""Resampling documents towards the distribution of a target.

Features are runs of one and two words, hashed into buckets. How much more often
a bucket occurs in the target than in the corpus is its gain, a document's weight
is the mean gain of its features, and documents are drawn by weight with Gumbel
noise, which samples without replacement in proportion to the weights.

The corpus is counted by segments: separators of words include the line feed, so
texts are cut into lines, equal lines are found globally, the features of a
distinct line are counted once and multiplied by its occurrences, and only the
pairs of words that a line feed parts are counted from the documents themselves.
Counts of a task are reduced to one row per bucket before they move.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runloom.llm import tokens
from runloom.llm.stage import documents, staged

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
APART = tokens.separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
# Words up to this many bytes are hashed side by side.
_SHORT = 64


def _crc_table() -> np.ndarray:
    """The change of a CRC-32 by one byte, for each value of its low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _behind() -> np.ndarray:
    """[n, place, value]: what a byte of a checksum becomes when n zero bytes follow."""
    table = np.zeros((_SHORT + 1, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _SHORT + 1):
        table[n] = _CRC[table[n - 1] & 255] ^ (table[n - 1] >> 8)
    return table


_BEHIND = _behind()


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes, by columns over runs of falling length."""
    length = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(length, _SHORT + 1), kind="stable")
    falling = -length[order]
    short = int(np.searchsorted(falling, -_SHORT))
    at, state = start[order[short:]], crc[short:]
    for k in range(_SHORT):
        n = int(np.searchsorted(falling[short:], -k))
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    found = np.empty(len(start), np.uint32)
    found[order[short:]] = ~state
    for k in order[:short].tolist():
        found[k] = zlib.crc32(data[start[k] : end[k]])
    return found


def pair_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The CRC-32 of word, blank, next word, for the words numbered ``left``.

    A checksum is linear, so that of two strings in a row follows from both and
    the length of the second.
    """
    blank = ~crc[left]
    blank = ~(_CRC[(blank ^ np.uint32(0x20)) & 255] ^ (blank >> 8))
    right = left + 1
    n = (end - start)[right]
    short = np.minimum(n, _SHORT)
    found = crc[right].copy()
    for place in range(4):
        found ^= _BEHIND[short, place, (blank >> np.uint32(8 * place)) & 255]
    for k in np.flatnonzero(n > _SHORT).tolist():
        i = left[k]
        found[k] = zlib.crc32(data[start[i + 1] : end[i + 1]], zlib.crc32(b" ", zlib.crc32(data[start[i] : end[i]])))
    return found


def _parts(batch: pa.RecordBatch, column: int):
    """(slice, lower-cased bytes, start, end, first words) of a column of texts."""
    for part in tokens.slices(batch.column(column)):
        data = tokens.LOWER[part.data]
        yield part, data, *tokens.bounds(data, part.offsets, APART)


def _neighbours(first: np.ndarray, count: int) -> np.ndarray:
    """The words that have a next one in their own text."""
    last = np.zeros(count + 1, bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    return np.flatnonzero(~last[:count])


def _totals(buckets: int, total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])


def _count_lines(buckets: int):
    """Features inside of lines (column 0) that occur n times (column 1)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            times = np.asarray(batch.column(1))
            for part, data, start, end, first in _parts(batch, 0):
                own = np.repeat(times[part.row : part.row + len(first) - 1], np.diff(first))
                crc = checksums(data, start, end)
                np.add.at(total, crc % buckets, own)
                left = _neighbours(first, len(start))
                np.add.at(total, pair_checksums(data, start, end, crc, left) % buckets, own[left])
        yield _totals(buckets, total)

    return counted


def _count_seams(buckets: int):
    """Pairs of words of a text (column 0) with a line feed between them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part, data, start, end, first in _parts(batch, 0):
                feeds = np.flatnonzero(data == 0x0A)
                left = _neighbours(first, len(start))
                left = left[np.searchsorted(feeds, end[left]) < np.searchsorted(feeds, start[left + 1])]
                # Each pair by itself: its two words next to one another.
                both = np.stack([left, left + 1], 1).ravel()
                a, b = start[both], end[both]
                pairs = pair_checksums(data, a, b, checksums(data, a, b), np.arange(0, len(both), 2))
                total += np.bincount(pairs % buckets, minlength=buckets)
        yield _totals(buckets, total)

    return counted


def histogram(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table of texts; buckets without any are left out.

    Lines are grouped as they are, not by a hash, and reduced in each task first,
    so neither a line that fills a third of the table nor an unlucky pair of lines
    does harm.
    """
    texts = texts.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    lines = lines.groupBy("line").agg(F.count("*").alias("n"))
    kinds = "bucket int, n long"
    inside, seams = lines.mapInArrow(_count_lines(buckets), kinds), texts.mapInArrow(_count_seams(buckets), kinds)
    return inside.unionByName(seams).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the logarithm of how much likelier a bucket is in the target, rounded down."""
    buckets = len(corpus)
    s, t = float(corpus.sum()) + buckets, float(target.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(corpus, target)], np.int64)


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    """A histogram on the driver: one row per bucket at most."""
    total = np.zeros(buckets, np.int64)
    for row in counts.collect():
        total[row["bucket"]] = row["n"]
    return total


def _weigh(gain: np.ndarray):
    buckets = len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, start, end, first in _parts(batch, 1):
                crc = checksums(data, start, end)
                own = np.zeros(len(start) + 1, np.int64)
                own[:-1] = gain[crc % buckets]
                left = _neighbours(first, len(start))
                own[left] += gain[pair_checksums(data, start, end, crc, left) % buckets]
                sums = np.r_[0, np.cumsum(own)][first]
                words = np.diff(first)
                features = np.maximum(2 * words - 1, 0)
                yield pa.record_batch([
                    batch.column(0).slice(part.row, len(words)), pa.array(words, pa.int64()), pa.array(features, pa.int64()),
                    pa.array(np.diff(sums) // np.maximum(features, 1), pa.int64()),
                ], names=["doc_id", "n_words", "n_features", "weight"])

    return weighed


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank.

    Of the N documents with at least ``least_words`` words those with the
    floor(percent * N / 100) highest scores are drawn and ranked from 1; ties go
    to the smaller id, ``rank`` is null for all others. Null, empty and wordless
    texts have no features and weight 0. A row that repeats is a document each
    time it occurs, has the same score and the next rank. Rows without an id are
    left out, of the counts too; an empty corpus gives an empty table and an
    empty target leaves every bucket at its smoothed share. Other columns are
    not looked at.

    Ranks come from a distributed sort: rows are written in ranges of the order,
    and the rows of the ranges before are added to the place within a range.
    """
    docs = documents(docs, id_col, text_col)
    gain = gains(_collected(histogram(docs, "text", buckets), buckets), _collected(histogram(target, target_text_col, buckets), buckets))
    weighed = docs.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((share.cast("double") + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words)
    scored = staged(scored, "scored")
    order = [F.desc("fit"), F.desc("score"), F.asc("doc_id")]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = scored.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # The number of the range in the upper bits, the place within it in the lower 33.
    placed = staged(ranges.withColumn("place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("place", 33)
    sizes = {r["part"]: (r["n"], r["fit"]) for r in placed.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), F.count_if("fit").alias("fit")).collect()}  # one row per range
    drawn, before, upto = percent * sum(fit for _, fit in sizes.values()) // 100, {}, 0
    for k in sorted(sizes):
        before[k] = upto
        upto += sizes[k][0]
    starts = docs.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    rank = F.col("_before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(starts), part == F.col("_part"))  # one row per range
    return ranked.select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, in their own columns; all rows of an id that is drawn."""
    chosen = resample(docs, target, id_col=id_col, **options).filter("rank is not null").select(F.col("doc_id").alias("_chosen"))
    return docs.join(chosen, docs[id_col] == chosen["_chosen"], "left_semi")
