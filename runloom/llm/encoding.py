"""Token ids of many texts at once, by a public word tokenizer.

The tokenizer parts a text into runs (letters, single digits, anything else) and
looks at each run alone. A batch is therefore cut where runs certainly end,
equal parts are found by Arrow's dictionary encoding, and only parts not seen
before go through the tokenizer; the ids of a text are then gathered from those
of its parts. Parts that are plain lower-case letters need neither its normaliser
nor its expressions and go through a copy without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from runloom.llm.tokens import LOWER, Slice, slices

# Bytes worked on at once; a longer text is cut at white space.
CHUNK = 8 << 20
# Parts kept by a task before it starts anew.
CACHE = 600_000
# Parts that one call gets as one text.
_AT_ONCE = 4000
_WORD_END = "</w>"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.where(_SPACE, 0x20, LOWER).astype(np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
# Lead bytes of two-byte letters, and what else follows them: two signs, and a capital that becomes two characters.
_LATIN = {0xC3: (0x97, 0xB7), 0xC4: (0xB0,), 0xC5: ()}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z and the capitals of Latin-1 lower-cased and white space as blanks, and which are known to be letters."""
    low = _FOLD[data]
    letter = _LETTER[low]
    wide = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5)) + 1
    for lead, others in _LATIN.items():
        at = wide[data[wide - 1] == lead]
        at = at[~np.isin(data[at], others)]
        if lead == 0xC3:
            low[at[data[at] <= 0x9E]] += 0x20
        letter[at] = True
    return low, letter


class Encoder:
    """Ids of texts, with a bounded memory of parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for each in (self.full, self.plain):
            each.encode_special_tokens = True
        # Parts of letters only: parting at blanks is all that is left to do.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closing[[k for piece, k in vocabulary.items() if piece.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, parts: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(parts, range(first, first + len(parts))))
        need = first + len(parts)
        if need > len(self.start):
            self.start, self.count = (np.r_[x, np.zeros(2 * need - len(x), np.int64)] for x in (self.start, self.count))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(self.used + 2 * len(ids), np.uint32)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[first:need] = counts
        self.start[first:need] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _learn(self, parts: list[bytes]) -> None:
        plain, others = [], []
        for part in parts:
            # Of ASCII letters, or of others that are lower-case and in composed form.
            if part.isalpha() or (text := part.decode()).isalpha() and text.islower() and max(text) < "ƀ":
                plain.append(part)
            else:
                others.append(part)
        for k in range(0, len(plain), _AT_ONCE):
            some = plain[k : k + _AT_ONCE]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._add(some, ids, np.diff(ends, prepend=0))
            else:
                others += some
        for k in range(0, len(others), _AT_ONCE):
            some = others[k : k + _AT_ONCE]
            found = [x.ids for x in self.full.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)]
            counts = np.array([len(x) for x in found], np.int64)
            self._add(some, np.array([i for x in found for i in x], np.uint32), counts)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the bytes, and how many each of the texts between the offsets has."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        low, letter = _lowered(data)
        blank = low == 0x20
        # A part starts with a text, behind blanks, and where a letter meets an ASCII character that is none.
        opens = np.zeros(len(low) + 1, bool)
        opens[offsets] = True
        opens[1:-1] |= blank[:-1]
        opens[1:-1] |= letter[:-1] & ~letter[1:] & (low[1:] < 0x80)
        at = np.flatnonzero(opens[:-1] & ~blank)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        before = np.cumsum(blank, dtype=np.int32 if len(low) < 1 << 31 else np.int64)
        cuts = pa.py_buffer(np.r_[at - before[at], len(low) - before[-1]].astype(np.int64))
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, cuts, pa.py_buffer(low[~blank])]).dictionary_encode()
        entries = parts.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self._forget()
        missing = [x for x in entries if x not in self.known]
        if missing:
            self._learn(missing)
        which = np.array(list(map(self.known.__getitem__, entries)), np.int64)[np.asarray(parts.indices)]
        counts = self.count[which]
        total = np.cumsum(counts)
        places = np.repeat(self.start[which] - total + counts, counts) + np.arange(total[-1])
        upto = np.r_[0, total][np.searchsorted(at, offsets)]
        return self.ids[places], np.diff(upto)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice one after the other, and how many each has."""
        if len(part.data) <= CHUNK:
            return self._chunk(part.data, part.offsets)
        ids, counts = [], np.zeros(len(part.offsets) - 1, np.int64)
        for k, (low, high) in enumerate(zip(part.offsets[:-1], part.offsets[1:])):
            for a, b in _pieces(part.data, int(low), int(high)):
                some, _ = self._chunk(part.data[a:b], np.array([0, b - a]))
                ids.append(some)
                counts[k] += len(some)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts


def _pieces(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """A text in runs of about ``CHUNK`` bytes that end at white space."""
    while high - low > CHUNK:
        blanks = np.flatnonzero(_SPACE[data[low + CHUNK // 2 : low + CHUNK]])
        if len(blanks):
            cut = low + CHUNK // 2 + int(blanks[-1]) + 1
        else:
            later = np.flatnonzero(_SPACE[data[low + CHUNK : high]])
            cut = low + CHUNK + int(later[0]) + 1 if len(later) else high
        yield low, cut
        low = cut
    if high > low:
        yield low, high


def documents_of(batch: pa.RecordBatch, encoder: Encoder, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of the texts of a batch's second column; ``end`` closes each."""
    for part in slices(batch.column(1), CHUNK):
        ids, counts = encoder.encode(part)
        upto = np.cumsum(counts)
        ids = np.insert(ids, upto, end).astype("<u4", copy=False)
        upto += np.arange(1, len(counts) + 1)
        for k, (low, high) in enumerate(zip([0, *upto[:-1].tolist()], upto.tolist())):
            yield part.row + k, ids[low:high]
