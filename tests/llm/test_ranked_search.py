"""Ranked search: the ball tree against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from runloom.llm import ranked_search as rs

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall((text or "").encode().lower())


def ranked(docs, items, best):
    """Score everything."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item in {i for i, _ in items if i is not None}:
        query, scores = {t for i, x in items if i == item for t in terms(x)}, []
        for i, c in counts:
            n = sum(c.values())
            m = 50 + 50 * n * n_docs // n_terms if n else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in query if c[t])
            if score > 0:
                scores.append((-score, i))
        found += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:best])]
    return sorted(found)


def corpus(deal, n):
    vocabulary = ["w%d" % k for k in range(80)] + ["É", "ü1", "Ä", "MixED"]
    rows = [(k, " ".join(deal.choices(vocabulary, k=deal.randrange(40)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "... --"), *((n + 3 + k, rows[5][1]) for k in range(60)), (n + 80, "w1 " * 30_000)]


@pytest.mark.parametrize("at_once", [rs.AT_ONCE, 60])
def test_agrees_with_scoring_everything(spark, at_once):
    deal = random.Random(at_once)
    docs = corpus(deal, 400)
    items = [(k, " ".join(deal.choices(["w%d" % x for x in range(90)] + ["É", "mixed", "nowhere"], k=9))) for k in range(12)]
    items += [(3, "w7 w8"), (3, "w7 w8"), (50, None), (51, "!"), (52, "unknown"), (None, "w1")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, rank int, item_id int").repartition(4)
    queries = spark.createDataFrame([(*r, 3) for r in items], "item_id int, text string, doc_id int")
    found = rs.search(frame, queries, best=20, block=64, leaf=8, at_once=at_once)
    assert sorted(tuple(r) for r in found.collect()) == ranked(docs, items, 20)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a c"), (3, "d"), (None, "a")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "A b")], "item_id string, text string")
    found = sorted((r["rank"], r["doc_id"]) for r in rs.search(docs, items).collect())
    assert found == [(1, 1), (2, 1), (3, 2)]
    assert rs.search(docs.limit(0), items).collect() == []
    empty = rs.search(docs, items.limit(0))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_prune():
    deal = np.random.default_rng(7)
    width, n = 60, 600
    sizes = deal.integers(1, 12, n)
    # Documents about one of six subjects, so that balls can be told apart.
    words = [np.sort(deal.choice(10, k % 10 + 1 if k < 10 else s, replace=False) + 10 * (k % 6)) for k, s in enumerate(np.minimum(sizes, 10))]
    first = np.r_[0, np.cumsum([len(w) for w in words])]
    flat, values = np.concatenate(words), deal.integers(1, 1_000_000, first[-1])
    tree = rs.BallTree(flat, values, first, width, leaf=16)
    pruned = 0
    for subject in range(6):
        own = np.arange(10 * subject, 10 * subject + 4)
        weights = deal.integers(1, 20_000, len(own))
        query = np.zeros(width, np.int64)
        query[own] = weights
        exact = np.add.reduceat(values * query[flat], first[:-1])
        upper = tree.bounds(own, weights.astype(float))
        for (low, high), bound in zip(tree.spans, upper):
            assert exact[tree.order[low:high]].max() <= bound
        best = rs.Best(10)
        leaves = rs.search_tree(tree, np.arange(n), own, weights, best)
        pruned += sum(not h for h in tree.halves) - leaves
        order = np.lexsort((np.arange(n), -exact))[:10]
        assert best.scores.tolist() == exact[order].tolist() and best.ids.tolist() == order.tolist()
    assert pruned > 0
