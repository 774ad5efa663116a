"""Harmonic packing: round trips, padding, classes, workers."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import encoding, harmonic
from runloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
ODD = [
    None, "", " \n\t", "İstanbul. İ.", "don't can't.", "ΣΑΣ ΣΑΣ.", "éa. É", "naïve!?", "ǅ. ŉ.", "a\x00b", "x<|endoftext|>y",
    "1234.5", "ß ẞ.", "Ä,Ö;Ü", "ſt ſ.", "a b", "ªº.", "日本 日本.", "a.b,c", "...", "word " * 300, "o'tool 'S ÷2× é÷",
]


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoding.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return [x.ids for x in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def checked(rows, ids, capacity, end=2):
    """Every id in one place, gapless sequences; the lengths of the sequences."""
    back, sequences = {i: [] for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(back[r.doc_id]) and r.length == len(r.ids) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id]) + 1
        back[r.doc_id] += r.ids
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert back == {i: [*x, end] for i, x in ids.items()}
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    return [sum(n for _, n in spans) for spans in sequences.values()]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, start int, ids string")


def test_round_trip_without_padding(spark):
    deal = random.Random(3)
    texts = ODD + [" ".join(deal.choices(["Alpha", "beta.", "γ", "x9", "(d)", "É!"], k=deal.randrange(1, 90))) for _ in range(90)]
    docs = frame(spark, list(enumerate(texts))).repartition(3)
    lengths = checked(harmonic.pack(docs, capacity=64).collect(), dict(enumerate(encoded(texts))), 64)
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths)
    assert sum(n < 64 for n in lengths) <= 3 * 6


def test_any_text_is_encoded_as_the_tokenizer_does():
    deal = random.Random(5)
    signs = ["a", "B", "é", "É", "é", "́", "'s", "'ll", "'T", " ", "\n", "\t", " ", " ", "1", "½", "$", "…", "÷", "×", "ß",
             "ẞ", "ǅ", "İ", "ı", "ſ", "ŉ", "Σ", "日", "😀", "‍", "<|startoftext|>", "≠", "\x1c", "\x85", "\x00", "_", "’s", "ﬁ", "Ω", "ª", "²"]
    texts = ["".join(deal.choices(signs, k=deal.randrange(15))) for _ in range(4000)]
    import pyarrow as pa

    encoder = encoding.Encoder(encoding.default_tokenizer())
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = [ids[:-1].tolist() for _, ids in encoding.documents_of(batch, encoder, 2)]
    assert found == encoded(texts)


def test_a_very_long_text_is_cut_at_white_space(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encoding, "CHUNK", 1000)
    texts = ["Räume, don't " * 700, "x" * 5000, "short", "a " * 900 + "y" * 3000 + " b"]
    batch = pa.record_batch([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])
    found = [ids[:-1].tolist() for _, ids in encoding.documents_of(batch, encoding.Encoder(encoding.default_tokenizer()), 2)]
    assert found == encoded(texts)


def test_a_class_holds_its_number_of_documents():
    packer = harmonic.Packer(120, 8, 1000, 0)
    for k in range(60):
        packer.add(harmonic.Run(k, 0, 31 + k % 9, np.zeros(31 + k % 9, np.uint32)))
    assert not packer.done and len(packer.waiting) == 20
    assert all(len(runs) == 3 for _, runs in packer.waiting)
    packer.finish()
    assert sum(len(r.ids) for _, _, r in packer.done) == sum(31 + k % 9 for k in range(60))


def test_most_documents_stay_whole(spark):
    rows = QUERIES["op11_harmonic"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pieces = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("ids"), F.max("doc_tokens").alias("all"))
    assert pieces.filter("ids <> all").isEmpty() and pieces.count() == docs.count()
    short = pieces.filter(F.col("all") < 4096)
    assert short.filter("n = 1").count() > 0.7 * short.count()
    sizes = Counter(r.n for r in rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect())
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes)


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (1, "c"), (None, "x")]).coalesce(1)
    found = harmonic.pack(docs, capacity=8).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == [(1, 2), (1, 3), (1, 3)]
    assert harmonic.pack(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        harmonic.pack(docs, capacity=100)
