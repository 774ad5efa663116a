"""Language identification by inference on mixtures.

Each language is a distribution over byte trigrams (lower-case ASCII, everything
that is no letter as one blank), counted over all labelled text. A document is
taken as a mixture: expectation-maximisation estimates the proportions in which
the languages produced its trigrams. The set of languages is selected by
penalised likelihood, starting with the best single one and adding the one with
the largest proportion outside as long as twice the gain in log-likelihood
exceeds a penalty for each language that grows with the text's logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from runloom.llm import tokens
from runloom.llm.stage import staged

BUCKETS = 1 << 13
UNKNOWN = "und"
STEPS = 12
PENALTY = 6.0
SMOOTHING = 0.5
# A model with more languages than this is refused: it is sent to every task.
MOST_LANGUAGES = 512

_FOLD = tokens.LOWER.copy()
_FOLD[:0x80][[not chr(b).isalpha() for b in range(0x80)]] = 0x20
_LETTER = regex.compile(r"\p{L}")


def _grams(part: tokens.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each trigram, without those across texts and runs of blanks."""
    data = _FOLD[part.data].astype(np.uint64)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    owner = np.repeat(np.arange(len(part.offsets) - 1), np.diff(part.offsets))
    good = (owner[:-2] == owner[2:]) & ~((data[:-2] == 0x20) & (data[1:-1] == 0x20)) & ~((data[1:-1] == 0x20) & (data[2:] == 0x20))
    buckets = (codes[good] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return owner[:-2][good], buckets.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["lang", "bucket", "n"])
        totals.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for part in tokens.slices(batch.column(0)):
            owner, buckets = _grams(part)
            own = langs[part.row : part.row + len(part.offsets) - 1]
            names = sorted(set(own))
            number = np.array([names.index(x) for x in own])
            counts = np.bincount(number[owner] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, counts):
                totals[name] = totals[name] + row if name in totals else row
            if len(totals) > MOST_LANGUAGES:
                yield from rows()
    yield from rows()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and a (languages, buckets) matrix of probabilities.

    Rows with a null text or language teach nothing. The counts of every text
    are added up in Spark; what comes back has one row for each language and
    bucket.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counted = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = staged(counted, "trigrams")
    names = [r["lang"] for r in counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names.sort()
    counts = np.zeros((len(names), BUCKETS))
    if names:
        data = counted.toPandas()
        counts[np.searchsorted(names, data["lang"].to_numpy(str)), data["bucket"].to_numpy()] = data["n"].to_numpy()
    counts += SMOOTHING
    return names, counts / counts.sum(axis=1, keepdims=True)


def _fit(first: np.ndarray, owner: np.ndarray, count: np.ndarray, chance: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over the allowed languages of each text: proportions and log-likelihoods."""
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for step in range(STEPS + 1):
        weighed = share[owner] * chance
        total = np.maximum(weighed.sum(axis=1), 1e-300)
        if step == STEPS:
            return share, np.add.reduceat(count * np.log(total), first)
        share = np.add.reduceat(weighed * (count / total)[:, None], first, axis=0)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)


def mixtures(owner: np.ndarray, buckets: np.ndarray, n_texts: int, chance: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each text over its selected set; zeros for texts without trigrams."""
    out = np.zeros((n_texts, len(chance)))
    if not len(owner) or not len(chance):
        return out
    table = np.bincount(owner * BUCKETS + buckets, minlength=n_texts * BUCKETS)
    cells = np.flatnonzero(table)
    texts, count, chance = cells // BUCKETS, table[cells].astype(float), chance.T[cells % BUCKETS]
    present, first, owner = np.unique(texts, return_index=True, return_inverse=True)
    size = np.add.reduceat(count, first)
    singles = np.add.reduceat(count[:, None] * np.log(chance), first, axis=0)
    rows = np.arange(len(present))
    allowed = np.zeros_like(singles)
    allowed[rows, singles.argmax(axis=1)] = 1
    share, best = allowed.copy(), singles.max(axis=1)
    full, _ = _fit(first, owner, count, chance, np.ones_like(singles))
    growing = np.ones(len(present), bool)
    for _ in range(chance.shape[1] - 1):
        # Only the texts whose set may still grow are fitted again.
        some = np.flatnonzero(growing)
        of_some = growing[owner]
        if not len(some):
            break
        wider = allowed[some]
        wider[np.arange(len(some)), np.where(wider > 0, -1.0, full[some]).argmax(axis=1)] = 1
        place = np.cumsum(growing) - 1
        own = place[owner[of_some]]
        tried, likely = _fit(np.searchsorted(own, np.arange(len(some))), own, count[of_some], chance[of_some], wider)
        better = 2 * (likely - best[some]) > penalty * np.log(np.maximum(size[some], 2))
        good = some[better]
        allowed[good], share[good], best[good] = wider[better], tried[better], likely[better]
        growing[:] = False
        growing[good] = True
    out[present] = share
    return out


def _predict(names: list[str], chance: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for part in tokens.slices(texts):
                n = len(part.offsets) - 1
                share = mixtures(*_grams(part), n, chance)
                own = texts.slice(part.row, n)
                lettered = np.array([x.is_valid and _LETTER.search(x.as_py()) is not None for x in own])
                top = share.argmax(axis=1) if names else np.zeros(n, int)
                known = lettered & bool(names)
                # A text too short for a trigram has letters but no evidence: the first language, at an even chance.
                score = np.where(known, np.where(share.any(axis=1), share.max(axis=1, initial=0), 1 / max(len(names), 1)), 0.0)
                yield pa.record_batch([
                    batch.column(0).slice(part.row, n), pa.array([names[t] if k else UNKNOWN for t, k in zip(top, known)], pa.string()),
                    pa.array(np.clip(score, 0, 1)),
                    pa.array([[names[i] for i in np.flatnonzero(s > 0)] if k else [] for s, k in zip(share, known)], pa.list_(pa.string())),
                ], names=["doc_id", "lang_pred", "score", "languages"])

    return rows


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, languages.

    ``languages`` is the selected set, ``lang_pred`` the one with the largest
    proportion and ``score`` that proportion; ties go to the first name. A text
    that is null or has no letter is ``und`` with score 0, as is every text if
    the model knows no language. A text too short for a trigram gets the first
    language at an even chance. Repeated rows each get a row, and so do rows
    without an id; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(*model), "doc_id long, lang_pred string, score double, languages array<string>")
