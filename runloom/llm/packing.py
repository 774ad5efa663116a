"""Packing documents into sequences, by bin completion.

Documents of the same length are interchangeable, so packing needs their lengths
only: at most as many counts as a sequence has tokens. On these counts bin
completion branches over the fillings of the sequence that holds the largest
document left. A filling that another one dominates (it could be made from the
other by taking documents out or changing one for a shorter one) is not looked
at, and a branch ends when its waste exceeds what the best solution known could
still save. The first branch at each bin is the best fit, so the first solution
is that of best-fit decreasing. A filling is applied as often as the counts
allow, which keeps the number of different ones near that of lengths however
many documents there are.

The result is a list of fillings. Pieces are then numbered within their length,
in Spark and without gathering a length, and looked up in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from runloom.llm.encoding import Encoder, default_tokenizer, documents_of
from runloom.llm.stage import documents, staged

CAPACITY = 4096
END = 1
# Branch-and-bound looks at so many bins at most before it keeps the best solution so far.
NODES = 2_000
_BLOCKS = 256


def _piece_rows(path: str, capacity: int, end: int):
    """Token ids of texts, cut into pieces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            ids, pieces, starts, lengths, sums, codes = [], [], [], [], [], []
            names = batch.column(0).to_pylist()
            for row, code in documents_of(batch, encoder, end):
                for k, at in enumerate(range(0, len(code), capacity)):
                    part = code[at : at + capacity]
                    ids.append(names[row])
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part))
                    codes.append(part.astype(np.int32))
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            cut = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
            yield pa.record_batch([
                pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(flat, pa.int32())),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token ids of each document, ended by ``end`` and cut where they exceed a sequence."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return docs.mapInArrow(_piece_rows(tokenizer, capacity, end), kinds)


def _fillings(counts: dict[int, int], lengths: list[int], room: int, limit: int = 24) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, fullest first, at most three pieces deep after the best fit.

    For up to two more pieces the last one is always the largest that fits, as
    any shorter one in its place is dominated.
    """
    found: dict[tuple[int, ...], int] = {}

    def fits(space: int, taken: tuple[int, ...]) -> int | None:
        k = bisect_right(lengths, space) - 1
        while k >= 0:
            if counts[lengths[k]] > taken.count(lengths[k]):
                return k
            k -= 1
        return None

    def greedy(taken: tuple[int, ...], space: int) -> None:
        while (k := fits(space, taken)) is not None:
            taken, space = (*taken, lengths[k]), space - lengths[k]
        found.setdefault(tuple(sorted(taken, reverse=True)), space)

    greedy((), room)
    if min(found.values()):
        k, tried = fits(room, ()), 0
        while k is not None and k >= 0 and tried < 60:
            one = lengths[k]
            if counts[one]:
                tried += 1
                greedy((one,), room - one)
                second, looked = fits(room - one, (one,)), 0
                while second is not None and second >= 0 and looked < 30 and min(found.values()):
                    two = lengths[second]
                    if counts[two] > (one == two):
                        looked += 1
                        greedy((one, two), room - one - two)
                    second -= 1
                if not min(found.values()):
                    break
            k -= 1
    return sorted(found, key=lambda f: (found[f], [-x for x in f]))[:limit]


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of sequences that hold the whole histogram.

    Depth first over fillings of the bin of the largest piece left. The allowed
    waste follows from the best solution known; a solution at the lower bound
    ends the search.
    """
    counts = {x: n for x, n in histogram.items() if n}
    total = sum(n * x for x, n in counts.items())
    bound = -(-total // capacity)
    best: list[tuple[int, tuple[int, ...]]] | None = None
    best_bins = seen = bins = waste = 0
    lengths = sorted(counts)

    def options() -> list[tuple[int, ...]]:
        """Fillings with the largest piece left, the best one last."""
        while lengths and not counts[lengths[-1]]:
            lengths.pop()
        top = lengths[-1]
        counts[top] -= 1
        found = [(top, *f) for f in _fillings(counts, lengths, capacity - top)]
        counts[top] += 1
        return found[::-1]

    # A level of the search: the fillings still to try, and the one applied.
    path: list[tuple[list[tuple[int, ...]], list[tuple[int, tuple[int, ...]]]]] = [(options() if counts else [], [])]
    while path and counts:
        todo, applied = path[-1]
        if applied:  # take back what the last branch did
            times, filling = applied.pop()
            for x in filling:
                counts[x] += times
            lengths[:] = sorted(x for x, n in counts.items() if n)
            bins, waste = bins - times, waste - times * (capacity - sum(filling))
        if not todo or (best is not None and (seen > nodes or best_bins <= bound)):
            path.pop()
            continue
        filling = todo.pop()
        times = min(counts[x] // filling.count(x) for x in set(filling))
        lost = waste + times * (capacity - sum(filling))
        if best is not None and total + lost > (best_bins - 1) * capacity:
            continue
        seen += best is not None
        for x in filling:
            counts[x] -= times
        bins, waste = bins + times, lost
        applied.append((times, filling))
        if any(counts[x] for x in lengths):
            path.append((options(), []))
        else:
            best, best_bins = [done[0] for _, done in path], bins
            if bins <= bound:
                break
    return best or []


def _place(fillings: list[tuple[int, tuple[int, ...]]]):
    """Sequence and offset of the n-th piece of each length."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for times, filling in fillings:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            each = filling.count(length)
            rows = slots.setdefault(length, [])
            rank = rows[-1][0] + rows[-1][4] if rows else 0
            rows.append((rank, first, each, offset, each * times))
            offset += each * length
        first += times
    tables = {length: np.array(rows, np.int64) for length, rows in slots.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                rows = tables[int(x)]
                of = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                k = rank[own] - of[:, 0]
                sequence[own] = of[:, 1] + k // of[:, 2]
                offset[own] = of[:, 3] + k % of[:, 2] * x
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "rank"), pa.array(sequence), pa.array(offset)],
                names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    return placed


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rank`` from 0 within a key, dealing a key of any size over many tasks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(_BLOCKS)))
    sizes = rows.groupBy(key, "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "blocks")
    inside = F.row_number().over(Window.partitionBy(key, "block").orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(sizes, [key, "block"]).withColumn("rank", F.col("before") + F.col("_inside")).drop("block", "before", "_inside")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    Every document ends with the id ``end``, so null and empty texts are one
    token. Only documents over ``capacity`` are cut. Sequences are numbered from
    0 and filled without gaps. Equal lengths are told apart by id and piece; a
    row that repeats is packed as often as it occurs. Rows without an id are
    left out; an empty table gives an empty one.
    """
    rows = pieces(documents(docs, id_col, text_col), tokenizer or default_tokenizer(), capacity, end)
    rows = staged(rows if with_ids else rows.drop("ids"), "pieces", free=True)
    # One row for each length, so at most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Ids stay on their row, so that rows of one id cannot be mistaken for one another.
    columns = [c for c in rows.columns if with_ids or c != "ids"]
    kinds = T.StructType([*rows.select(*columns).schema.fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset"))])
    ranked = numbered(rows.select(*columns), "length", ["doc_id", "piece"]).select(*columns, "rank")
    placed = ranked.mapInArrow(_place(complete_bins(histogram, capacity)), kinds)
    return placed.select(*[c for c in columns if c != "ids"], "sequence_id", "offset", *(["ids"] if with_ids else []))
