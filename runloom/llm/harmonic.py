"""Packing documents into sequences, harmonically.

A document of n ids belongs to the class k = capacity div n: at least k of its
kind fit into a sequence, and sequences of the class hold k documents each,
whatever their lengths. So a worker needs one open sequence per class, looks at
each document once and agrees with no other worker on anything. Documents of
more than a sequence give full sequences first, and what is left has a class.

Pure harmonic packing leaves a part of each sequence empty. As documents may be
cut, a sequence that has its k documents waits for filler: documents too small
for a class of their own, and, once the waiting room exceeds ``WAITING``
sequences, the next documents that fit into it. Most documents stay whole. What
is open when a worker ends is laid end to end; the last stretch becomes sequences
of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from runloom.llm.encoding import Encoder, default_tokenizer, documents_of
from runloom.llm.stage import documents

CAPACITY = 4096
END = 2
# Classes with sequences of their own; shorter documents are filler.
CLASSES = 32
# Room, in sequences, that may wait for filler.
WAITING = 8
# Sequence numbers that a task may use.
_PER_TASK = 1 << 40

_KINDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Run(NamedTuple):
    """Some consecutive ids of a document."""

    doc_id: int
    start: int
    total: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Run, Run | None]:
        """The first n ids, and the rest."""
        if n >= len(self.ids):
            return self, None
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


class Packer:
    """The sequences of one worker. Holds at most a few runs for each class and waiting sequence."""

    def __init__(self, capacity: int, classes: int, waiting: int, first: int):
        self.capacity, self.classes, self.most = capacity, classes, waiting * capacity
        self.open: dict[int, list[Run]] = {}
        # Sequences with all their documents but room left, the oldest first.
        self.waiting: deque[tuple[int, list[Run]]] = deque()
        self.room = 0
        self.small: list[Run] = []
        self.small_size = 0
        self.next = first
        self.done: list[tuple[int, int, Run]] = []

    def _close(self, runs: list[Run]) -> None:
        offset = 0
        for run in runs:
            self.done.append((self.next, offset, run))
            offset += len(run.ids)
        self.next += 1

    def _fill(self, run: Run) -> None:
        """Cut a run into the waiting sequences; it is not longer than their room."""
        rest: Run | None = run
        while rest is not None:
            room, runs = self.waiting.popleft()
            piece, rest = rest.cut(room)
            runs.append(piece)
            self.room -= len(piece.ids)
            if len(piece.ids) == room:
                self._close(runs)
            else:
                self.waiting.appendleft((room - len(piece.ids), runs))

    def add(self, run: Run) -> None:
        while len(run.ids) >= self.capacity:
            piece, rest = run.cut(self.capacity)
            self._close([piece])
            if rest is None:
                return
            run = rest
        size = len(run.ids)
        kind = self.capacity // size
        if size <= self.room and (kind > self.classes or self.room >= self.most):
            self._fill(run)
        elif kind > self.classes:
            self._small(run)
        else:
            runs = self.open.setdefault(kind, [])
            runs.append(run)
            if len(runs) == kind:
                del self.open[kind]
                room = self.capacity - sum(len(r.ids) for r in runs)
                if room:
                    self.waiting.append((room, runs))
                    self.room += room
                else:
                    self._close(runs)

    def _small(self, run: Run) -> None:
        """Filler that nothing waits for: sequences of it alone, end to end."""
        rest: Run | None = run
        while rest is not None:
            piece, rest = rest.cut(self.capacity - self.small_size)
            self.small.append(piece)
            self.small_size += len(piece.ids)
            if self.small_size == self.capacity:
                self._close(self.small)
                self.small, self.small_size = [], 0

    def finish(self) -> None:
        """Pack what is still open, without padding."""
        left = [*self.small, *(run for kind in sorted(self.open) for run in self.open[kind])]
        self.small, self.open = [], {}
        for k, run in enumerate(left):
            if len(run.ids) > self.room:
                left = left[k:]
                break
            self._fill(run)
        else:
            left = []
        left = [*(run for _, runs in self.waiting for run in runs), *left]
        self.waiting.clear()
        total = sum(len(run.ids) for run in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        queue = deque(left)
        for size in sizes:
            runs: list[Run] = []
            while size:
                piece, more = queue.popleft().cut(size)
                runs.append(piece)
                size -= len(piece.ids)
                if more is not None:
                    queue.appendleft(more)
            self._close(runs)

    def rows(self) -> pa.RecordBatch:
        """What has been packed since the last call."""
        done, self.done = self.done, []
        flat = np.concatenate([r.ids for _, _, r in done]).astype(np.int32) if done else np.zeros(0, np.int32)
        lengths = [len(r.ids) for _, _, r in done]
        columns = {
            "doc_id": [r.doc_id for _, _, r in done], "start": [r.start for _, _, r in done], "length": lengths,
            "ids_crc32": [zlib.crc32(r.ids) for _, _, r in done], "doc_tokens": [r.total for _, _, r in done],
            "sequence_id": [s for s, _, _ in done], "offset": [o for _, o, _ in done],
        }
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int32()))
        return pa.record_batch([*(pa.array(x, pa.int64()) for x in columns.values()), ids], names=[*columns, "ids"])


def _pack(tokenizer: str, capacity: int, end: int, classes: int, waiting: int, with_ids: bool):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        packer = Packer(capacity, classes, waiting, TaskContext.get().partitionId() * _PER_TASK)
        count = len(_KINDS.split(",")) + with_ids
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, ids in documents_of(batch, encoder, end):
                packer.add(Run(names[row], 0, len(ids), ids.copy()))  # a view would keep the whole batch
                if len(packer.done) >= 4096:
                    yield packer.rows().select(range(count))
        packer.finish()
        yield packer.rows().select(range(count))

    return packed


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, classes: int = CLASSES,
         waiting: int = WAITING, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Every document ends with the id ``end``, so null and empty texts are one
    token. Each id lies in one piece. Every sequence has ``capacity`` ids or a
    power of two of them, so none needs padding; the latter are a dozen for each
    task at most. ``capacity`` is a power of two itself. Sequences are numbered
    within a task, from a multiple of 2^40 on; they depend on how the input is
    cut into tasks, not on what other tasks do, and a task that runs again gives
    the same ones. Ties do not arise: documents are taken as they come. A row
    that repeats is packed as often as it occurs; rows without an id are left
    out; an empty table gives an empty one; other columns are not looked at. A
    very long text is encoded in stretches and held as ids.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    kinds = _KINDS + ", ids array<int>" if with_ids else _KINDS
    rows = _pack(tokenizer or default_tokenizer(), capacity, end, classes, waiting, with_ids)
    return documents(docs, id_col, text_col).mapInArrow(rows, kinds)
