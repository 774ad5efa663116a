"""Quality by nearest-neighbour voting in a latent semantic space.

A text is a vector of hashed byte trigrams, weighed by the logarithm of their
counts and by how few documents have them, as counted over the whole corpus. The
singular vectors of a labelled sample turn it into a latent vector. The sample's
latent vectors, of bounded number and size, are sent to every task; a task takes
its documents in blocks, multiplies each block with all of them to get exact
cosines, and lets the nearest vote for their labels, weighed by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runloom.llm import tokens
from runloom.llm.stage import staged

FEATURES = 1 << 12
DIMENSIONS = 48
NEIGHBOURS = 15
# The labelled sample has at most this many rows of each label.
SAMPLE = 1500
_BLOCK = 256
_ROUNDS = 12


def _grams(part: tokens.Slice) -> np.ndarray:
    """(texts, features) counts of hashed trigrams."""
    n = len(part.offsets) - 1
    data = part.data.astype(np.uint64)
    if len(data) < 3:
        return np.zeros((n, FEATURES), np.float32)
    codes = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    owner = np.repeat(np.arange(n), np.diff(part.offsets))
    good = owner[:-2] == owner[2:]
    buckets = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)
    cells = owner[:-2][good] * FEATURES + buckets[good].astype(np.int64)
    return np.bincount(cells, minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) for at most so many texts at once."""
    for part in tokens.slices(texts):
        for k in range(0, len(part.offsets) - 1, _BLOCK):
            at = part.offsets[k : k + _BLOCK + 1]
            yield part.row + k, _grams(tokens.Slice(0, part.data[at[0] : at[-1]], at - at[0]))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for _, counts in _blocks(batch.column(0)):
            total[:-1] += (counts > 0).sum(axis=0)
            total[-1] += len(counts)
    yield pa.record_batch([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["feature", "n"])


def _weighed(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * rarity
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _vectors(rarity: np.ndarray):
    """Vectors as the places of their values, then the values, two bytes each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts in _blocks(batch.column(0)):
                values = _weighed(counts, rarity)
                packed = []
                for v in values:
                    at = np.flatnonzero(v)
                    packed.append(at.astype("<u2").tobytes() + v[at].astype("<f2").tobytes())
                yield pa.record_batch([
                    batch.column(1).slice(row, len(counts)), pa.array(packed, pa.binary()),
                ], names=["label", "vector"])

    return rows


def _principal(matrix: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The first right singular vectors and values, by subspace iteration.

    Needs little beside the matrix, unlike a whole decomposition. The start is
    fixed, so the same matrix gives the same vectors.
    """
    width = min(2 * dimensions, *matrix.shape)
    basis = np.random.default_rng(0).standard_normal((matrix.shape[1], width)).astype(np.float32)
    for _ in range(_ROUNDS):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    image = matrix @ basis
    values, turn = np.linalg.eigh((image.T @ image).astype(np.float64))
    top = values.argsort()[::-1][:dimensions]
    return basis @ turn[:, top], np.sqrt(np.maximum(values[top], 0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The model: rarity of features, latent axes, latent vectors and labels of the sample.

    ``labels`` must hold only rows that may be learned from. The rarity counts
    every document. The sample takes, of each label, the at most ``sample`` rows
    with the smallest hash of their id, so it is the same in every run. Rows
    without id or label teach nothing, of several labels for one id the greatest
    counts, and null texts are empty.
    """
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_document_counts, "feature long, n long")
    counted = counted.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(FEATURES + 1)
    seen[counted["feature"].to_numpy()] = counted["n"].to_numpy()
    rarity = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 0.05
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [known.filter(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for x in (0, 1)]
    # At most 2 * sample ids.
    chosen = F.broadcast(staged(chosen[0].union(chosen[1]), "sample"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    rows = texts.select("text", "label").mapInArrow(_vectors(rarity), "label int, vector binary")
    rows = rows.orderBy("label", "vector").limit(2 * sample).toPandas()
    if not len(rows):
        return {"rarity": rarity, "axes": np.zeros((FEATURES, 1)), "vectors": np.zeros((0, 1)), "labels": np.zeros(0)}
    matrix = np.zeros((len(rows), FEATURES), np.float32)
    for k, v in enumerate(rows["vector"]):
        half = len(v) // 2
        matrix[k, np.frombuffer(v[:half], "<u2")] = np.frombuffer(v[half:], "<f2")
    known_labels = rows["label"].to_numpy(np.float64)
    del rows
    axes, values = _principal(matrix, dimensions)
    axes = axes[:, values > 1e-3 * max(values.max(), 1e-6)]
    vectors = matrix @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return {"rarity": rarity, "axes": axes, "vectors": vectors, "labels": known_labels}


def _vote(model: dict[str, np.ndarray], neighbours: int):
    labels, vectors = model["labels"], model["vectors"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = labels.mean() if len(labels) else 0.5
        for batch in batches:
            for row, counts in _blocks(batch.column(1)):
                latent = _weighed(counts, model["rarity"]) @ model["axes"]
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                score = np.full(len(counts), prior)
                if len(labels):
                    cosine = latent @ vectors.T
                    k = min(neighbours, len(labels))
                    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 2
                    total = weight.sum(axis=1)
                    score = np.where(total > 0, (weight * labels[near]).sum(axis=1) / np.where(total > 0, total, 1), prior)
                yield pa.record_batch([batch.column(0).slice(row, len(counts)), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])

    return rows


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per row of ``docs``: doc_id and score, the weighed share of label 1 among the nearest.

    Null, empty and one- or two-byte texts resemble nothing and get the sample's
    share of label 1, as does every text if nothing was learned from (0.5 then).
    Ties among the nearest are settled by the order of the sample. Repeated rows
    each get a row, and so do rows without an id; an empty table gives an empty
    one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_vote(model, neighbours), "doc_id long, score double")
