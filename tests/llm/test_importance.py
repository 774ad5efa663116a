"""Importance resampling against a plain count of every feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from runloom.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").encode().lower())
    return len(words), [*words, *(a + b" " + b for a, b in zip(words, words[1:]))]


def drawn(rows, target, percent=25, least=20):
    """The contract, read off word for word."""
    def count(texts):
        return Counter(zlib.crc32(f) % 10000 for t in texts for f in features(t)[1])

    s, t = count(text for _, text in rows), count(target)
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    found = []
    for doc_id, text in rows:
        n, own = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in (zlib.crc32(f) % 10000 for f in own)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        found.append((doc_id, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in found if r[1] >= least), key=lambda r: (-r[4], r[0]))
    ranks = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks.setdefault(r[0], []).append(k + 1)
    return found, ranks


def texts(deal, n):
    pool = ["Wort", "MOT", "été", "É", "x" * 70, "y" * 200, "a1", "don't", "p.q", "日本", "end", "of", "the", "_", "--"]
    lines = [" ".join(deal.choices(pool, k=deal.randrange(12))) for _ in range(25)]
    return ["\n".join(deal.choices(lines, k=deal.randrange(9))) for _ in range(n)]


def test_agrees_with_a_plain_count(spark):
    deal = random.Random(2)
    rows = [(k, t) for k, t in enumerate([None, "", "\n\n", "one", "one\ntwo", " \x00 ", "a" * 100_000, *texts(deal, 150)])]
    target = [None, "", *texts(deal, 9)]
    docs = spark.createDataFrame([(i, t, 5, 9) for i, t in rows], "doc_id long, text string, score int, n long").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    found = {r.doc_id: r for r in importance.resample(docs, bench).collect()}
    expected, ranks = drawn(rows, target)
    assert {i: tuple(r)[:5] for i, r in found.items()} == {r[0]: r for r in expected}
    assert {i: [r.rank] for i, r in found.items() if r.rank is not None} == ranks
    assert {r.doc_id for r in importance.draw(docs, bench).collect()} == set(ranks)


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    deal = random.Random(4)
    long = [" ".join(["w%d" % deal.randrange(50) for _ in range(30)]) for _ in range(20)]
    rows = [(k % 15, t) for k, t in enumerate(long)] + [(3, long[3])] * 4
    docs = spark.createDataFrame([*rows, (None, long[0])], "doc_id long, text string")
    bench = spark.createDataFrame([("w1 w2",)], "text string")
    found = importance.resample(docs, bench, percent=50).collect()
    expected, ranks = drawn(rows, ["w1 w2"], percent=50)
    assert sorted(tuple(r)[:5] for r in found) == sorted(expected)
    by_id = {}
    for r in found:
        if r.rank is not None:
            by_id.setdefault(r.doc_id, []).append(r.rank)
    assert {i: sorted(x) for i, x in by_id.items()} == ranks
    assert importance.resample(docs.limit(0), bench).collect() == []
    assert all(r.weight <= 0 for r in importance.resample(docs, bench.limit(0)).collect())


def test_checksums_are_those_of_the_bytes():
    deal = np.random.default_rng(1)
    data = deal.integers(0, 256, 60_000).astype(np.uint8)
    size = np.r_[deal.integers(1, 90, 900), 64, 65, 20_000]
    end = np.cumsum(size)
    start = end - size
    crc = importance.checksums(data, start, end)
    plain = [data[a:b].tobytes() for a, b in zip(start, end)]
    assert crc.tolist() == [zlib.crc32(x) for x in plain]
    left = np.arange(len(size) - 1)
    pairs = importance.pair_checksums(data, start, end, crc, left)
    assert pairs.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(plain, plain[1:])]
