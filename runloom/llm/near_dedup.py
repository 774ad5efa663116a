"""Near duplicates by odd sketches.

A document is the set of its distinct five-word shingles. MinHash samples of the
set are cut into bands; documents that agree in a band are candidates. The
documents that have a candidate are sampled more finely, and these samples are
folded into an odd sketch: a bitmap in which each (sample number, value) toggles
one bit. Of two sketches the bits that differ come from the samples that differ,
so the population count of their XOR estimates the similarity, precisely where it
is high; candidates whose count could not come from a similarity at the threshold
are dropped, and the rest is confirmed on the full sets.

Documents with the same set form a class and are represented by its smallest
id. Within a bucket no all-pairs join runs: members are compared with one centre,
then with a few, and each time only where the bucket still holds more than one
component, so a bucket of many near copies costs its size. Buckets that are open
after that hold documents which are much alike and yet not linked, such as pages
of one template. Their members are joined on the rarest shingles of their full
sets, as many as a link needs one of: of n shingles of the larger document
n - ceil(t n) + 1, of the smaller one n - ceil(2 t n / (1 + t)) + 1. What all
pages of a template share is frequent and so in no prefix; a pair comes up only
where it may be linked, and no link that could join two components is lost.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runloom.llm import tokens
from runloom.llm.graph import components
from runloom.llm.stage import discard, documents, staged

SHINGLE = 5
BANDS, ROWS = 48, 5
# Samples and bits of an odd sketch. At the threshold its estimate spreads by 0.016.
SAMPLES, SKETCH = 1024, 2048
# Centres of a bucket in each round; None is the join on rare shingles of what is left.
ROUNDS = (1, 16, None)
# Counters that say how frequent a shingle is among the members of open buckets; they order shingles and decide nothing.
COUNTERS = 1 << 17
# Documents are joined on one such part of their rare shingles after the other, so that a join shuffles a part only.
PARTS = 8
_KINDS = "doc_id long, n long, set_id binary, bands array<long>"


def shingle_sets(part: tokens.Slice) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = tokens.words(part, tokens.WHITE_SPACE, lower=True)
    shingles = tokens.windows(w.hash, SHINGLE)
    for first, end in zip(w.first[:-1], w.first[1:]):
        if end - first >= SHINGLE:
            yield np.unique(shingles[first : end - SHINGLE + 1])
        elif end > first:
            yield tokens.windows(w.hash[first:end], int(end - first))
        else:
            yield np.zeros(0, np.uint64)


def _name(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sampler(count: int, seed: int):
    """MinHash samples of a set, by linear permutations of 32 bits."""
    factor = (tokens.randoms(count, seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shift = (tokens.randoms(count, seed + 1) >> np.uint64(32)).astype(np.uint32)

    def samples(hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        lowest = np.full(count, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 256):
            block = x[k : k + 256, None] * factor
            block += shift
            np.minimum(lowest, block.min(axis=0), out=lowest)
        return lowest

    return samples


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples = _sampler(BANDS * ROWS, 2)
    of_band = tokens.randoms(BANDS, 4)
    for batch in batches:
        ids = batch.column(0)
        for part in tokens.slices(batch.column(1)):
            sets = list(shingle_sets(part))
            n = np.array([len(s) for s in sets])
            low = np.array([samples(s) for s in sets]).astype(np.uint64)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for row in range(ROWS):
                bands = tokens.mix(bands * np.uint64(0x9E3779B97F4A7C15) + low[:, row::ROWS])
            bands ^= of_band
            some = n > 0
            keys = [_name(s) for s in sets]
            yield pa.record_batch([
                ids.slice(part.row, len(sets)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                tokens.lists(bands[some].view(np.int64).ravel(), np.where(some, BANDS, 0), pa.int64()),
            ], names=["doc_id", "n", "set_id", "bands"])


def odd_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The odd sketch of each text's samples, as 64-bit words, and the name of its set."""
    samples = _sampler(SAMPLES, 5)
    numbers = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        ids = batch.column(0)
        for part in tokens.slices(batch.column(1)):
            keys, sketches = [], []
            for s in shingle_sets(part):
                keys.append(_name(s))
                bit = tokens.mix(numbers + samples(s)) % np.uint64(SKETCH)
                odd = np.bincount(bit.astype(np.int64), minlength=SKETCH) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.record_batch([
                ids.slice(part.row, len(sketches)), pa.array(keys, pa.binary()),
                tokens.lists(np.concatenate(sketches), np.full(len(sketches), SKETCH // 64), pa.int64()),
            ], names=["doc_id", "set_id", "sketch"])


def most_differing(percent: int, z: float = 4.5) -> int:
    """The XOR count that a pair at the threshold exceeds with negligible chance.

    With d of k samples differing, 2d toggles fall into m bits. Their number
    spreads as a binomial, the bits they leave set as the odd ones of so many
    balls in bins; z standard deviations of both together are allowed.
    """
    differ = 1 - percent / 100
    toggles = 2 * SAMPLES * differ
    left = math.exp(-2 * toggles / SKETCH)
    mean = SKETCH / 2 * (1 - left)
    by_sampling = 2 * math.sqrt(SAMPLES * differ * (1 - differ)) * left
    by_folding = math.sqrt(SKETCH / 4 * (1 - left * left) - toggles * left * left)
    return math.ceil(mean + z * math.hypot(by_sampling, by_folding))


def _confirm(percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def set_of(doc_id: int, text: pa.Scalar) -> np.ndarray:
            if doc_id in recent:
                recent.move_to_end(doc_id)
            else:
                part = next(tokens.slices(pa.array([text.as_py()], pa.large_string())))
                recent[doc_id] = next(shingle_sets(part))
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[doc_id]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for k in range(len(a)):
                x, y = set_of(a[k], batch.column(2)[k]), set_of(b[k], batch.column(3)[k])
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))
            yield kept.rename_columns(["a", "b"])

    return confirmed


def _open_members(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    of_bucket = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ones = staged(of_bucket.filter("low < high").select("bucket"), "open")
    return members.join(open_ones, "bucket", "left_semi")


def _judged(percent: int):
    """Whether sizes and sketches of two documents allow a link; evaluated inside the join, so that others never become rows."""
    near = 100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")
    differing = sum(
        (F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("c_sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    return (F.col("component") != F.col("c_component")) & near & (differing <= most_differing(percent))


def _ends() -> list:
    return [F.least("doc_id", "c_doc_id").alias("a"), F.greatest("doc_id", "c_doc_id").alias("b")]


def _pairs(members: DataFrame, sketches: DataFrame, centres: int, percent: int) -> DataFrame:
    """Pairs to confirm: in every bucket of several components, centres with members of others."""
    members = _open_members(members)
    slot = F.pmod(F.xxhash64("doc_id", "bucket"), F.lit(centres))
    chosen = members.groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct("doc_id", "n", "component")).alias("c"))
    chosen = chosen.select("bucket", "c.*")
    columns = ["doc_id", "n", "component", "sketch"]
    members, chosen = (rows.join(sketches, "doc_id").select("bucket", *columns) for rows in (members, chosen))
    chosen = staged(chosen.select(F.col("bucket").alias("c_bucket"), *[F.col(c).alias(f"c_{c}") for c in columns]), "centres")
    return members.join(chosen, (F.col("bucket") == F.col("c_bucket")) & _judged(percent)).select(*_ends()).distinct()


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for part in tokens.slices(batch.column(0)):
            for s in shingle_sets(part):
                np.add.at(total, s & np.uint64(COUNTERS - 1), 1)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], names=["counter", "n"])


def _rarest(counts, percent: int):
    """(doc_id, shingle, last) of the shingles a link needs one of; ``last`` says whether also as the smaller document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counts.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for part in tokens.slices(batch.column(1)):
                owners, shingles, smaller, places = [], [], [], []
                for k, s in enumerate(shingle_sets(part)):
                    n = len(s)
                    large, small = n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1
                    order = np.lexsort((s, total[s & np.uint64(COUNTERS - 1)]))[:large]
                    owners.append(np.full(len(order), ids[part.row + k]))
                    shingles.append(s[order])
                    smaller.append(np.arange(len(order)) < small)
                    places.append(np.arange(len(order)))
                yield pa.record_batch([
                    pa.array(np.concatenate(owners)), pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(smaller)),
                    pa.array(np.concatenate(places), pa.int32()),
                ], names=["doc_id", "shingle", "last", "place"])

    return found


def _rare_pairs(members: DataFrame, texts: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs to confirm among all that is left in open buckets, by the rarest shingles of the full sets."""
    spark = members.sparkSession
    left = staged(_open_members(members).select("doc_id", "n", "component").distinct(), "left")
    texts = staged(texts.join(left.select("doc_id"), "doc_id", "left_semi"), "texts")
    counts = texts.select("text").mapInArrow(_count_shingles, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # one row per counter
    total = np.zeros(COUNTERS, np.int64)
    total[found["counter"].to_numpy()] = found["n"].to_numpy()
    sent = spark.sparkContext.broadcast(total)
    kinds = "doc_id long, shingle long, last boolean, place int"
    rare = texts.select("doc_id", "text").mapInArrow(_rarest(sent, percent), kinds).distinct()
    rare = staged(rare.join(left, "doc_id"), "rare", free=True)
    sent.destroy()
    discard(texts, left)
    # A shingle of one component brings no two together.
    shared = rare.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    shared = staged(shared.select("shingle"), "shared")
    own = rare.join(shared, "shingle", "left_semi").groupBy("doc_id", "n", "component").agg(F.array_sort(F.collect_list(F.struct("place", "shingle", "last"))).alias("own"))
    own = staged(own.join(sketches.select("doc_id", "sketch"), "doc_id"), "prefixes", free=True)
    discard(rare, shared)
    found = [staged(_at_shingles(own, k, percent), "pairs", free=True) for k in range(PARTS)]
    return functools.reduce(DataFrame.union, found).distinct()


def _at_shingles(own: DataFrame, part: int, percent: int) -> DataFrame:
    """Pairs that come up at the shingles of one part. All documents order shingles alike, so a pair comes up at the first one it shares."""
    # Picked before they become rows, as each row copies the whole prefix.
    numbered = F.transform("own", lambda x, i: F.struct(i.alias("at"), x.alias("it")))
    picked = F.filter(numbered, lambda x: F.pmod(x["it"]["shingle"], F.lit(PARTS)) == part)
    rows = own.select("doc_id", "n", "component", "sketch", "own", F.explode(picked).alias("one")).select("*", "one.at", "one.it")
    earlier = F.transform(F.slice("own", F.lit(1), F.col("at")), lambda x: x["shingle"])
    rows = rows.select("doc_id", "n", "component", "sketch", "it.shingle", "it.last", earlier.alias("earlier"))
    small = rows.filter("last").select(*[F.col(c).alias(f"c_{c}") for c in ("shingle", "doc_id", "n", "component", "sketch", "earlier")])
    larger = (F.col("c_n") < F.col("n")) | ((F.col("c_n") == F.col("n")) & (F.col("c_doc_id") < F.col("doc_id")))
    first = ~F.arrays_overlap("earlier", "c_earlier")
    pairs = rows.join(small, (F.col("shingle") == F.col("c_shingle")) & larger & _judged(percent) & first)
    return pairs.select(*_ends()).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_size.

    Documents are linked whose sets have at least ``percent`` hundredths of
    their union in common; ``component_id`` is the smallest id that links reach
    and ``kept`` says whether it is the document's own. Null, empty and blank
    texts have no shingle and are linked with nothing; up to four words are one
    shingle. Equal texts tie and go to the smallest id. Rows that repeat an id
    each give a row and count as copies of one another only if their sets are
    equal. Rows without an id are left out; an empty table gives an empty one.
    """
    docs = documents(docs, id_col, text_col)
    signed = staged(docs.mapInArrow(_signatures, _KINDS), "signatures")
    classes = signed.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"))
    classes = staged(classes, "classes")
    named = signed.join(classes, "set_id", "left")
    reps = staged(named.filter("doc_id = rep").dropDuplicates(["doc_id", "set_id"]).select("doc_id", "set_id", "n", "bands"), "reps")

    buckets = reps.select(F.explode("bands").alias("bucket"), "doc_id", "n")
    shared = staged(buckets.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                    .filter("low < high").select("bucket"), "buckets")
    members = staged(buckets.join(shared, "bucket", "left_semi"), "members", free=True)
    discard(shared)
    wanted = staged(members.select("doc_id").distinct(), "wanted")
    texts = staged(docs.join(wanted, "doc_id", "left_semi"), "texts", free=True)
    sketched = texts.mapInArrow(odd_sketches, "doc_id long, set_id binary, sketch array<long>")
    sketches = staged(sketched.join(reps.select("doc_id", "set_id"), ["doc_id", "set_id"]).drop("set_id"), "sketches")
    discard(wanted, reps)

    labels, links = None, None
    for centres in ROUNDS:
        labelled = members.withColumn("component", F.col("doc_id")) if labels is None else members.join(
            labels.withColumnRenamed("vertex", "doc_id"), "doc_id", "left"
        ).withColumn("component", F.coalesce("component", "doc_id"))
        found = _rare_pairs(labelled, texts, sketches, percent) if centres is None else _pairs(labelled, sketches, centres, percent)
        likely = staged(found, "pairs", free=True)
        if likely.isEmpty():
            continue
        both = likely
        for end in ("a", "b"):
            both = both.join(texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}")), end)
        found = both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long")
        links = staged(found if links is None else found.union(links), "confirmed", free=True)
        labels = components(links)
    result = signed.select("doc_id", "n", "set_id").join(classes, "set_id", "left")
    if labels is None:
        result = result.withColumn("component", F.lit(None).cast("long"))
    else:
        result = result.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )
