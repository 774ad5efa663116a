"""Words and windows of many texts at once, as numpy arrays.

Tasks get text in Arrow batches. Everything here works on a batch's bytes as a
whole, in slices of about a megabyte, instead of text by text. Words are told
apart by 64 bits under a key that the driver draws, runs of words by polynomials
modulo 2^64 over these, mixed at the end.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that look random."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.multiply.accumulate(np.r_[U64(1), np.full(size - 1, x, U64)]) for x in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


# Masks of the first so many bytes of eight.
_UPTO = np.r_[(U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1), ~U64(0)]
# Words over so many bytes are digested one by one.
_LONGEST = 64
# Drawn anew by every driver. Functions of this package travel to tasks by value
# (see the package), and the key with them, so all tasks of a run share it and
# nobody can make up words that collide.
_KEY = randoms(_LONGEST // 8 + 2, int.from_bytes(os.urandom(4), "little"))
_OF_WORDS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """Which bytes separate words; spans include both ends."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Slice(NamedTuple):
    """Some texts of a batch: their first row, and their bytes with offsets."""

    row: int
    data: np.ndarray
    offsets: np.ndarray


def slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Slice]:
    """The texts of a column in slices of at least one text. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield Slice(row, content[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


class Words(NamedTuple):
    """hash, start and end (bytes) of each word; the first word of each text, and one more."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end (bytes) of the words between separators; the first word of each text, and one more."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[True, ~inside[:-1]] if len(data) else inside, np.r_[~inside[1:], True] if len(data) else inside
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as binary strings, one behind the other."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    body = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    cuts = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=cuts[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(body)])


def words(part: Slice, apart: np.ndarray, lower: bool = False) -> Words:
    """The words between separators; none spans two texts."""
    data = LOWER[part.data] if lower else part.data
    start, end, first = bounds(data, part.offsets, apart)
    return Words(identities(data, start, end), start, end, first)


def identities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word, the same for equal words.

    Up to seven bytes and their number are the 64 bits, mixed under the key, so
    short words never share theirs. Of longer words eight bytes at a time are
    mixed in; very long ones get a keyed digest.
    """
    length = end - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    first = eight[start]
    short = (first & _UPTO[np.minimum(length, 7)]) | (length.astype(U64) << U64(56))
    hashes = mix(np.where(length > 7, first, short) ^ _KEY[0])
    some = np.flatnonzero(length > 7)
    hashes[some] += length[some].astype(U64) * _KEY[1]
    for k in range(1, _LONGEST // 8 + 1):
        if not len(some):
            break
        # A word of a multiple of eight bytes ends with none.
        left = np.minimum(length[some] - 8 * k, 8)
        hashes[some] = mix(hashes[some] ^ (eight[np.minimum(start[some] + 8 * k, len(data))] & _UPTO[left]) ^ _KEY[1 + k])
        some = some[left == 8]
    for k in np.flatnonzero(length > _LONGEST).tolist():
        word = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=_KEY[0].tobytes())
        hashes[k] = int.from_bytes(word.digest(), "little")
    return hashes


def windows(hashes: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """A hash of every run of so many words; runs over the end of a text are the caller's to leave out."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _OF_WORDS[family].upto(len(hashes))
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n] + U64(length))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values cut into lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, kind))


def spans_of(first: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(text, first window, end) of each text long enough for a window."""
    for k in np.flatnonzero(np.diff(first) >= length):
        yield int(k), int(first[k]), int(first[k + 1]) - length + 1
