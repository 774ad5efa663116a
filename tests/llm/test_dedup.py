"""Exact, line, substring and near duplicates against brute force, and the odd cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from runloom.llm import decontamination, exact_dedup, line_dedup, near_dedup, substring_dedup

WHITE = "\x20\x09-\x0d"


def frame(spark, rows):
    """Rows of (doc_id, text) with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n int, kept string")


def corpus(seed):
    """Random texts that share passages, copies with small changes, blank, empty and null ones."""
    deal = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = deal.choices(words, k=80)
    texts = ["", None, " \t\n", "one", "one two three four", "Ünï\u00a0cöde \u2028 words", "a\nb\nc", "a\nb\nc\nd\na\nb\nc"]
    for k in range(30):
        own = deal.choices(words, k=deal.choice([3, 40, 60, 200]))
        if k % 3 == 0:
            own += passage[deal.randrange(20):] + deal.choices(words, k=5)
        texts.append(deal.choice([" ", "\n", "  "]).join(own))
    for k in range(25):
        changed = (texts[deal.randrange(8, 38)] or "").split(" ")
        for _ in range(deal.randrange(4)):
            changed[deal.randrange(len(changed))] = "changed"
        texts.append(" ".join(changed))
    texts += [texts[-1], texts[-1] + " ", texts[-2].upper(), "hot spot " * 3000, "hot spot " * 3000, *(["same text of five words"] * 40)]
    ids = deal.sample(range(1000), len(texts))
    return list(zip(ids, texts))


def split(text):
    return [w for w in re.split(f"[{WHITE}]+", text or "") if w]


@pytest.mark.parametrize("size", [4, 64])
def test_exact_duplicates(spark, size):
    rows = corpus(1)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(f"[{WHITE}]", "", t or "")].append((-len(t or ""), i))
    expected = {i: (min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(frame(spark, rows), size=size).collect()}
    assert got == expected


def test_identities_are_free_of_collisions(spark):
    # All blocks and pairs in one bin: names must still differ where the contents do.
    from pyspark.sql import functions as F

    rows = [(k, f"{k:03d}" * 40) for k in range(20)] + [(20, "003" * 40)]
    named = exact_dedup.identities(frame(spark, rows).select("doc_id", "text"), 4, lambda *c: F.lit(0).cast("long")).collect()
    names = {r.doc_id: (r.blocks, r.h, r.r) for r in named}
    assert len(set(names.values())) == 20 and names[20] == names[3]


def test_lines(spark):
    rows = corpus(2) + [(2000, "x\n\n\ny\n\n\ny"), (2001, "q\na\nb\nc"), (2002, "q\na\nb\nc"), (2003, "\n\n\n\n\n")]
    seen, expected = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n") if t else []
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        expected[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(frame(spark, rows)).collect()}
    assert got == expected


@pytest.mark.parametrize("seed", [3, 4])
def test_substrings(spark, seed):
    rows = corpus(seed)
    first = {}
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    expected = {}
    for i, t in rows:
        w = split(t)
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        expected[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == expected
    assert sum(x[1] for x in expected.values()) > 500


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    sets = {}
    for i, t in rows:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    low = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if low[b] < low[a] and common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    low[a], moved = low[b], True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


OPERATORS = [exact_dedup.exact_duplicates, line_dedup.remove_repeated_lines, substring_dedup.remove_repeats, near_dedup.near_duplicates]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_empty_tables_null_ids_and_null_texts(spark, operator):
    assert operator(frame(spark, []).limit(0)).count() == 0
    found = operator(frame(spark, [(None, "a b"), (1, None), (2, None)])).collect()
    assert sorted(r.doc_id for r in found) == [1, 2]


def thue_morse(n):
    """A word and its complement, alike to every polynomial hash modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_cannot_tell_apart(spark):
    for size in (64, 1024, 2048):
        one, two = thue_morse(size)
        around = [f"w{k}" for k in range(60)]
        texts = [" ".join([*around[:30], word, *around[30:]]) for word in (one, two)]
        alone = [" ".join([word] * 60) for word in (one, two)]
        docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *alone])], "doc_id long, text string")
        cut = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
        assert cut == {0: 0, 1: 0, 2: 0, 3: 0}
        near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs.filter("doc_id > 1")).collect()}
        assert near == {2: 2, 3: 3}
        items = spark.createDataFrame([(1, one), (2, " ".join([one] * 12))], "item_id long, text string")
        hits = {r.doc_id: r["items"] for r in decontamination.contamination(docs, items).collect()}
        assert hits == {0: ["1"], 1: [], 2: ["1", "2"], 3: []}


def test_all_tasks_share_the_key_of_the_driver(spark):
    from runloom.llm import tokens
    import numpy as np
    import pyarrow as pa

    texts = ["short", "a rather long wordwordword", "x" * 300, "exactly8", "sixteen-bytes-xx"] * 20

    def hashed(batches):
        for batch in batches:
            for part in tokens.slices(batch.column(0)):
                w = tokens.words(part, tokens.WHITE_SPACE)
                yield pa.record_batch([pa.array(w.hash.view(np.int64))], names=["h"])

    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    assert docs.mapInArrow(hashed, "h long").distinct().count() == len(set(" ".join(texts).split(" ")))


def test_pages_of_one_template_are_not_compared_with_one_another(spark, monkeypatch):
    """Documents that share 0.70 of their shingles with every other: pairs to confirm grow with the documents."""
    staged, template, pairs = near_dedup.staged, [f"t{k}" for k in range(300)], {}

    def watched(df, purpose, free=False):
        table = staged(df, purpose, free)
        if purpose == "pairs":
            rounds.append(table.count())
        return table

    monkeypatch.setattr(near_dedup, "staged", watched)
    for size in (300, 900):
        rounds = []
        # A block of own words in the middle: 300 + 56 words, of whose shingles 292 are shared by all.
        documents = [(k, " ".join([*template[:150], *[f"own{k}x{j}" for j in range(56)], *template[150:]])) for k in range(size)]
        documents += [(5000 + k, documents[k][1] + " and one more") for k in range(20)]
        found = near_dedup.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in found if r.doc_id >= 5000} == {5000 + k: k for k in range(20)}
        assert sum(r.kept for r in found) == size
        # What the centres leave open is all pairs of the template, of which the last round makes none.
        assert rounds[-1] < size
        pairs[size] = sum(rounds)
    assert pairs[900] < 4 * pairs[300]


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "same"), (1, "same"), (1, "sa me"), (1, "othe"), (2, "same"), (3, "x" * 5000), (3, "y" * 5000), (4, "x" * 5000)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = [(1, 1, 3, False, "same"), (1, 1, 3, True, "same"), (2, 1, 3, False, "same"), (1, 1, 1, True, "othe"),
                (3, 3, 2, True, "x" * 5000), (4, 3, 2, False, "x" * 5000), (3, 3, 1, True, "y" * 5000)]
    assert sorted(map(tuple, found)) == sorted((*r[:4], digest(r[4])) for r in expected)


def test_rare_shingles_are_joined_part_by_part_and_no_pair_is_lost(spark):
    entry = lambda place, shingle: (place, shingle, True)
    prefixes = {1: [3, 8, 9], 2: [8, 9, 21], 3: [4, 21], 4: [-5, 40], 5: [-5]}
    rows = [(d, 10, d, [entry(k, s) for k, s in enumerate(own)], [0] * (near_dedup.SKETCH // 64)) for d, own in prefixes.items()]
    own = spark.createDataFrame(
        rows, "doc_id long, n long, component long, own array<struct<place int, shingle long, last boolean>>, sketch array<long>")
    found = [[(r.a, r.b) for r in near_dedup._at_shingles(own, k, 75).collect()] for k in range(near_dedup.PARTS)]
    assert sorted(pair for part in found for pair in part) == [(1, 2), (2, 3), (4, 5)]
    # A pair comes up in the part of the first shingle it shares.
    assert found[0] == [(1, 2)] and (2, 3) in found[21 % 8] and (4, 5) in found[-5 % 8]
