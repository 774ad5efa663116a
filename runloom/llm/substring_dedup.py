"""Repeated passages by difference-cover anchors.

Windows of ``LENGTH`` words that occur in two documents are to be found although
only some positions are looked at. Let C be a difference cover modulo v: every
difference is that of two members. For positions i and j of equal windows there
is then a shift below v at which both i + shift and j + shift fall on C, so the
two share an anchor, the run of ``LENGTH - v + 1`` words that starts there. Only
anchors at positions on the cover are hashed and grouped. Around those that two
documents have, the match is extended: the full windows that hold such an anchor
are hashed, and a window goes if a smaller document has it.

Neither step makes pairs. Both reduce to the smallest and largest document of a
hash, with partial aggregates, and join that back to the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runloom.llm import tokens
from runloom.llm.stage import discard, documents, staged

LENGTH = 50
# A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = LENGTH - PERIOD + 1


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    on_cover = np.isin(np.arange(PERIOD), COVER)
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for part in tokens.slices(batch.column(1)):
            w = tokens.words(part, tokens.WHITE_SPACE)
            counts = np.diff(w.first)
            place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], counts)
            left = np.repeat(counts, counts) - place
            chosen = np.flatnonzero(on_cover[place % PERIOD] & (left >= ANCHOR) & (np.repeat(counts, counts) >= LENGTH))
            owner = np.repeat(np.arange(len(counts)), counts)[chosen]
            yield pa.record_batch([
                pa.array(tokens.windows(w.hash, ANCHOR)[chosen].view(np.int64)),
                pa.array(ids[part.row + owner]), pa.array(place[chosen], pa.int32()),
            ], names=["h", "doc_id", "at"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full windows that hold one of the anchors in column ``at``."""
    for batch in batches:
        ids, anchors = np.asarray(batch.column(0)), batch.column(2)
        for part in tokens.slices(batch.column(1)):
            w = tokens.words(part, tokens.WHITE_SPACE)
            one, two = (tokens.windows(w.hash, LENGTH, family) for family in (0, 1))
            for k, first, end in tokens.spans_of(w.first, LENGTH):
                at = np.unique(anchors[part.row + k].values.to_numpy(zero_copy_only=False))
                cover = np.zeros(end - first + 1, np.int64)
                np.add.at(cover, np.minimum(np.maximum(at - PERIOD + 1, 0), end - first), 1)
                np.add.at(cover, np.minimum(at + 1, end - first), -1)
                starts = np.flatnonzero(np.cumsum(cover)[:-1])
                yield pa.record_batch([
                    pa.array(one[first + starts].view(np.int64)), pa.array(two[first + starts].view(np.int64)),
                    pa.array(np.full(len(starts), ids[part.row + k])), pa.array(starts, pa.int32()),
                ], names=["w1", "w2", "doc_id", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the words out that the windows in column ``at`` cover."""
    for batch in batches:
        for part in tokens.slices(batch.column(1)):
            w = tokens.words(part, tokens.WHITE_SPACE)
            counts, texts, gone = np.diff(w.first), [], []
            for k in range(len(counts)):
                first, n = w.first[k], counts[k]
                at = batch.column(2)[part.row + k]
                starts = at.values.to_numpy(zero_copy_only=False) if at.is_valid else np.zeros(0, np.int64)
                starts = starts[starts + LENGTH <= n]
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + LENGTH, -1)
                out = np.cumsum(cover)[:-1] > 0
                kept = first + np.flatnonzero(~out)
                data = part.data.data
                texts.append(b" ".join([bytes(data[a:b]) for a, b in zip(w.start[kept], w.end[kept])]))
                gone.append(int(out.sum()))
            yield pa.record_batch([
                batch.column(0).slice(part.row, len(counts)), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    Words are what white space separates. A word goes if a window of ``LENGTH``
    words covers it whose word sequence also starts in a document with a smaller
    id; windows are judged on the input. ``kept_text`` has the other words,
    joined by one space. Null, empty and blank texts have no words; texts under
    ``LENGTH`` words stay whole, as do repeats inside one document. Rows that
    repeat an id are one document to the rule and a row each in the result, cut
    at the same places. Rows without an id are left out; an empty table gives an
    empty one.
    """
    docs = documents(docs, id_col, text_col)
    anchors = docs.mapInArrow(_anchors, "h long, doc_id long, at int")
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    shared = staged(shared.select("h", "low"), "anchors", free=True)
    # All anchors that two documents have, and those of them that a smaller document has too.
    places = anchors.join(shared, "h").groupBy("doc_id").agg(
        F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("doc_id") > F.col("low"), F.col("at"))).alias("later"))
    places = staged(places, "places", free=True)
    # Windows are hashed twice from these texts rather than stored: they take several times the space.
    texts = staged(docs.join(places, "doc_id").select("doc_id", "text", "at", "later"), "matched", free=True)
    discard(shared, places)
    kinds = "w1 long, w2 long, doc_id long, at int"
    every = texts.select("doc_id", "text", "at").mapInArrow(_extend, kinds)
    owners = every.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    owners = staged(owners.select("w1", "w2", "low"), "owners", free=True)
    windows = texts.filter(F.size("later") > 0).select("doc_id", "text", "later").mapInArrow(_extend, kinds)
    later = windows.join(owners, ["w1", "w2"]).filter("doc_id > low").groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    later = staged(later, "later", free=True)
    discard(texts, owners)
    kinds = "doc_id long, n_words long, n_removed long, kept_text string"
    return docs.join(later, "doc_id", "left").select("doc_id", "text", "at").mapInArrow(_cut, kinds)
