"""Ranked lexical search by sparse ball trees.

A document is a sparse vector of what each of its terms adds to a score, a query
one of term weights, and a score their inner product. Documents come in blocks;
each block is split into balls, halves of halves, down to leaves. A ball knows
its centroid c and its radius r, so by Cauchy and Schwarz no document in it can
score more for a query q than <q, c> + |q| r; rounding only ever raises that
bound. Balls are taken from a heap, the highest bound first, until no bound
reaches the worst of the best documents known, and leaves are scored in integers.
So the result is exact, whatever the floating-point bounds are worth.

Only terms of some query can add to a score: vectors hold no others. Tasks keep
the best documents of their blocks; these are ranked in two steps, so that no
task gets the rows of one query from all tasks of a large cluster.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from runloom.llm import tokens
from runloom.llm.stage import discard, documents, staged

BEST = 50
BLOCK, LEAF = 4096, 64
# Pairs of query and term that are sent to every task; more are taken in several passes.
AT_ONCE = 50_000
APART = tokens.separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SALT = 64


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each pair once."""
    words = F.array_distinct(F.split(F.translate(F.col(text_col), _CAPITALS, _SMALL), _SEPARATORS))
    rows = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.explode(words).alias("term"))
    return rows.filter("term <> ''").distinct()


def _vectors(vocabulary):
    """Per document its number of terms, and the numbers and occurrences of those in the vocabulary."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.large_binary())
        size = max(1, len(known))
        for batch in batches:
            for part in tokens.slices(batch.column(1)):
                data = tokens.LOWER[part.data]
                start, end, first = tokens.bounds(data, part.offsets, APART)
                number = pc.index_in(tokens.strings(data, start, end), value_set=known)
                found = np.flatnonzero(np.asarray(number.is_valid()))
                owner = np.searchsorted(first, found, "right") - 1
                pairs, times = np.unique(owner * size + np.asarray(number.drop_null()), return_counts=True)
                n = len(first) - 1
                counts = np.bincount(pairs // size, minlength=n)
                yield pa.record_batch([
                    batch.column(0).slice(part.row, n), pa.array(np.diff(first), pa.int64()),
                    tokens.lists((pairs % size).astype(np.int32), counts, pa.int32()), tokens.lists(times, counts, pa.int64()),
                ], names=["doc_id", "n", "terms", "times"])

    return rows


def _frequencies(size: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

    return counted


class BallTree:
    """A block of sparse vectors in balls; every node is numbered, its halves behind it.

    ``terms`` and ``values`` hold one document after the other, ``first`` says
    where each starts, and one more; no document is empty.
    """

    def __init__(self, terms: np.ndarray, values: np.ndarray, first: np.ndarray, width: int, leaf: int = LEAF):
        self.width = width
        self.halves, self.spans, self.radius, centroids = [], [], [], []
        order = np.arange(len(first) - 1)
        norms = np.add.reduceat(values.astype(np.float64) ** 2, first[:-1])
        todo = [(0, len(order), -1)]
        for low, high, parent in todo:
            node = len(self.spans)
            own = order[low:high]
            t, v, f = _gathered(terms, values, first, own)
            centre = np.bincount(t, weights=v, minlength=width) / len(own)
            distance = _distances(t, v, f, norms[own], centre)
            self.spans.append((low, high))
            self.halves.append([])
            self.radius.append(math.sqrt(distance.max()))
            centroids.append(centre)
            if parent >= 0:
                self.halves[parent].append(node)
            if len(own) > leaf:
                # Along the line between two documents that are far apart.
                one = _dense(t, v, f, int(distance.argmax()), width)
                two = _dense(t, v, f, int(_distances(t, v, f, norms[own], one).argmax()), width)
                along = np.add.reduceat(v * (one - two)[t], f[:-1])
                order[low:high] = own[np.argsort(along, kind="stable")]
                middle = (low + high) // 2
                todo += [(low, middle, node), (middle, high, node)]
        self.order, self.radius = order, np.array(self.radius)
        self.centroids = np.stack(centroids, 1)
        self.terms, self.values, self.first = _gathered(terms, values, first, order)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no document of a node can exceed, with room for what rounding loses."""
        norm = math.sqrt(float(np.dot(weights, weights)))
        return (weights @ self.centroids[terms] + norm * self.radius) * (1 + 1e-9) + 1

    def scores(self, node: int, query: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a leaf; ``query`` has a weight for every term."""
        low, high = self.spans[node]
        a, b = self.first[low], self.first[high]
        return np.add.reduceat(self.values[a:b] * query[self.terms[a:b]], self.first[low:high] - a)


def _gathered(terms, values, first, rows):
    """The vectors of some rows, one after the other."""
    counts = first[rows + 1] - first[rows]
    upto = np.r_[0, np.cumsum(counts)]
    at = np.arange(upto[-1]) + np.repeat(first[rows] - upto[:-1], counts)
    return terms[at], values[at], upto


def _dense(terms, values, first, row: int, width: int) -> np.ndarray:
    found = np.zeros(width)
    found[terms[first[row] : first[row + 1]]] = values[first[row] : first[row + 1]]
    return found


def _distances(terms, values, first, norms, point) -> np.ndarray:
    """Squared distances of vectors from a point, rounded up beyond what cancellation can lose."""
    size = float(np.dot(point, point))
    return np.maximum(norms - 2 * np.add.reduceat(values * point[terms], first[:-1]) + size, 0) + 1e-10 * (norms + size) + 1


class Best:
    """The best documents of one query: highest score, then smallest id."""

    def __init__(self, count: int):
        self.count, self.scores, self.ids = count, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        if not some.any():
            return
        scores, ids = np.r_[self.scores, scores[some]], np.r_[self.ids, ids[some]]
        top = np.lexsort((ids, -scores))[: self.count]
        self.scores, self.ids = scores[top], ids[top]
        if len(top) == self.count:
            self.least = int(self.scores[-1])


def search_tree(tree: BallTree, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Put the best documents of a tree in; how many leaves were scored."""
    upper = tree.bounds(terms, weights.astype(np.float64))
    query = np.zeros(tree.width, np.int64)
    query[terms] = weights
    heap, leaves = [(-upper[0], 0)], 0
    while heap and -heap[0][0] >= best.least:
        bound, node = heapq.heappop(heap)
        if tree.halves[node]:
            for half in tree.halves[node]:
                # What bounds the whole bounds its halves.
                heapq.heappush(heap, (max(bound, -upper[half]), half))
        else:
            leaves += 1
            low, high = tree.spans[node]
            best.add(tree.scores(node, query), ids[tree.order[low:high]])
    return leaves


def _best(queries, n_docs: int, n_terms: int, width: int, count: int, block: int, leaf: int):
    """The best documents of a task's blocks, for every query."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = queries.value
        best = [Best(count) for _ in wanted]
        for part in _blocks(batches, block):
            ids, n = np.asarray(part.column(0)), np.asarray(part.column(1))
            terms, times = np.asarray(part.column(2).flatten()), np.asarray(part.column(3).flatten())
            sizes = np.asarray(pc.list_value_length(part.column(2)))
            length = np.repeat(50 + 50 * n * n_docs // n_terms, sizes)
            values = 1_000_000_000 * times // (1000 * times + 20 * length)
            # A term may occur too seldom in a long document to add anything; it stays, as a zero.
            tree = BallTree(terms, values, np.r_[0, np.cumsum(sizes)], width, leaf)
            for (own, weights), top in zip(wanted, best):
                if len(own):
                    search_tree(tree, ids, own, weights, top)
        yield pa.record_batch([
            pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int32()),
            pa.array(np.concatenate([b.ids for b in best]) if best else [], pa.int64()),
            pa.array(np.concatenate([b.scores for b in best]) if best else [], pa.int64()),
        ], names=["query", "doc_id", "score"])

    return found


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of a fixed size, the last one shorter."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, size - rows)
            batch = batch.slice(some.num_rows)
            held.append(some)
            rows += some.num_rows
            if rows == size:
                yield _joined(held)
                held, rows = [], 0
    if rows:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = BLOCK, leaf: int = LEAF, at_once: int = AT_ONCE,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per item and found document: item_id, rank, doc_id, score.

    An item finds its ``best`` highest-scoring documents with a score above 0,
    equal scores by ascending id; ``rank`` counts from 1. Items without a term,
    null items and items whose terms occur nowhere find none. An item id that
    repeats is one item with the terms of all its rows; a document row that
    repeats is a document each time, in the statistics and in the result. Null
    and empty texts have no terms and are no documents to the statistics. Rows
    without an id are left out; empty tables give an empty one; other columns
    are not looked at.

    At most about ``at_once`` pairs of item and term are sent to every task; when
    there are more, items are dealt into so many groups, and the documents are
    read once for each.
    """
    spark = docs.sparkSession
    docs = documents(docs, id_col, text_col)
    pairs = staged(item_terms(items, item_col, item_text_col), "queries")
    groups = max(1, -(-pairs.count() // at_once))
    results = []
    for group in range(groups):
        # Bounded by ``at_once``, and by the terms of one item.
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).groupBy("item_id").agg(
            F.array_sort(F.collect_list("term")).alias("terms")).orderBy("item_id").collect()
        vocabulary = sorted({t for r in rows for t in r["terms"]})
        width = len(vocabulary)
        if not width:
            continue
        sent = spark.sparkContext.broadcast([t.encode() for t in vocabulary])
        vectors = staged(docs.mapInArrow(_vectors(sent), "doc_id long, n long, terms array<int>, times array<long>"), "vectors")
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(vectors.select("terms").mapInArrow(_frequencies(width), "term int, df long").groupBy("term").agg(
            F.sum("df").alias("df")).collect())  # one row per word of the vocabulary
        number = {t: k for k, t in enumerate(vocabulary)}
        queries = []
        for r in rows:
            own = np.array([number[t] for t in r["terms"] if number[t] in df], np.int64)
            queries.append((own, np.array([term_weight(n_docs, df[k]) for k in own.tolist()], np.int64)))
        wanted = spark.sparkContext.broadcast(queries)
        search_blocks = _best(wanted, n_docs, n_terms, width, best, block, leaf)
        top = vectors.filter(F.size("terms") > 0).mapInArrow(search_blocks, "query int, doc_id long, score long")
        order = [F.desc("score"), F.asc("doc_id")]
        for keys in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(_SALT))], ["query"]):
            top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
        top = staged(top, "best")
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], pairs.select(
            F.lit(0).alias("_query"), "item_id").schema)
        results.append(top.join(F.broadcast(names), F.col("query") == F.col("_query")).select("item_id", "rank", "doc_id", "score"))
        discard(vectors)
        for each in (sent, wanted):
            each.destroy()
    if not results:
        kind = pairs.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found
