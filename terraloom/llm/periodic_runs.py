"""Periodic runs of words, found by a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4 q) words long, that
no neighbouring word extends. Such a run repeats itself over at least 3 q places, so one of the
places 0, 3 q, 6 q ... lies in it; extending the pair (i, i + q) in both directions from every such
place finds every run of period q. Over all q that is n / 3 * (1 + 1/2 + 1/3 + ...) extensions.

An extension compares at most `MODULUS - 1` words to reach two places that a difference cover has
sampled; from there it is a range minimum over the common prefixes of neighbouring sampled suffixes.
Only the sampled suffixes (6 of 31) are sorted, and only those of texts where an extension got that
far. Texts share arrays, parted by words that occur once, so numpy works on many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terraloom.llm import common

#: A perfect difference set. Every difference modulo 31 is one of two members.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

#: Words of texts that are worked on together, and grid places looked at together: array sizes only.
BATCH_WORDS = 200_000
BATCH_PLACES = 1_000_000


def _shifts() -> np.ndarray:
    """By difference d: a member a of the cover for which a + d is a member too."""
    shift = np.full(MODULUS, -1)
    for a in COVER:
        for b in COVER:
            shift[(b - a) % MODULUS] = a
    return shift


_SHIFT = _shifts()


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key being the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for key in keys:
        placed = key[order]
        new[1:] |= placed[1:] != placed[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


class Extensions:
    """Longest common extensions to the right in one array of word numbers.

    The last word must occur once, so that no two suffixes are alike.
    """

    def __init__(self, words: np.ndarray):
        top = int(words.max()) + 1
        # Words that occur once behind the end: every sampled place starts a whole block.
        self.words = np.concatenate([words, top + np.arange(2 * MODULUS)]).astype(np.int64)
        blocks = len(words) // MODULUS + 1
        starts = (np.array(COVER)[:, None] + MODULUS * np.arange(blocks)).ravel()
        self._place = np.full(blocks * MODULUS, -1)
        self._place[starts] = np.arange(len(starts))
        levels = self._levels(starts)
        order = np.argsort(levels[-1])
        self._rank = levels[-1]
        self._minima = self._sparse_table(self._neighbours(levels, starts, order))

    def _levels(self, starts: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first 1, 2, 4 ... blocks, until all differ."""
        bits = int(self.words.max()).bit_length()
        fit = max(1, 63 // bits)
        keys = []
        for first in range(0, MODULUS, fit):
            key = np.zeros(len(starts), np.int64)
            for k in range(first, min(first + fit, MODULUS)):
                key = (key << bits) | self.words[starts + k]
            keys.append(key)
        levels = [_ranks(*keys)]
        step = 1
        while levels[-1].max() + 1 < len(starts):
            ahead = np.full(len(starts), -1, np.int64)
            ahead[:-step] = levels[-1][step:]
            # The blocks of one residue stand together; its last block occurs once, so what is
            # ahead of it is never looked at in a tie.
            levels.append(_ranks(levels[-1], ahead))
            step *= 2
        return levels

    def _neighbours(
        self, levels: list[np.ndarray], starts: np.ndarray, order: np.ndarray
    ) -> np.ndarray:
        """Words that each sampled suffix shares with the one before it in the order."""
        a, b = order[:-1].copy(), order[1:].copy()
        common_words = np.zeros(len(order), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            common_words[1:] += np.where(same, MODULUS << k, 0)
            a, b = a + (same << k), b + (same << k)
        x, y = starts[a], starts[b]
        going = np.arange(len(x))
        for t in range(MODULUS):
            going = going[self.words[x[going] + t] == self.words[y[going] + t]]
            if not len(going):
                break
            common_words[1 + going] += 1
        return common_words

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        table, step = [values], 1
        while 2 * step <= len(values):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        return table

    def _sampled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of sampled suffixes at two different places each."""
        a, b = self._rank[self._place[a]], self._rank[self._place[b]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        found = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at, row = np.flatnonzero(level == k), self._minima[k]
            found[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k)) + 1])
        return found

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from i and from j on; i and j differ."""
        found, open_ = direct(self.words, i, j, (i % MODULUS), (j - i) % MODULUS)
        at = np.flatnonzero(open_)
        found[at] += self._sampled(i[at] + found[at], j[at] + found[at])
        return found


def direct(
    words: np.ndarray, i: np.ndarray, j: np.ndarray, residue: np.ndarray, apart: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Compare words up to the next two sampled places: words in common, and whether all agreed."""
    reach = (_SHIFT[apart] - residue) % MODULUS
    found = np.zeros(len(i), np.int64)
    open_ = np.ones(len(i), bool)
    going = np.flatnonzero(reach > 0)
    for t in range(MODULUS - 1):
        same = words[i[going] + t] == words[j[going] + t]
        open_[going[~same]] = False
        going = going[same]
        found[going] += 1
        going = going[reach[going] > t + 1]
        if not len(going):
            break
    return found, open_


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, q) of the harmonic grid of a text of n words, in parts of bounded size."""
    stride = LEAST_PERIODS - 1
    first = 1
    while first <= n // LEAST_PERIODS:
        # Places per period fall with the period, so the first period's count bounds all.
        last = min(n // LEAST_PERIODS, first + max(1, BATCH_PLACES * stride * first // n))
        q = np.arange(first, last + 1)
        counts = -(-(n - q) // (stride * q))
        period = np.repeat(q, counts)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield nth * stride * period, period
        first = last + 1


def _candidates(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Grid pairs of all texts whose two words agree: text, place in the shared array, period."""
    for text in np.flatnonzero(sizes >= LEAST_WORDS):
        for i, q in _grid(int(sizes[text])):
            i = i + starts[text]
            same = np.flatnonzero(words[i] == words[i + q])
            if len(same):
                yield np.full(len(same), text), i[same], q[same]


def find(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of each text of word numbers: rows of start, length, period by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.empty((0, 3), np.int64)
    found: list[np.ndarray] = [none] * len(texts)
    if not len(texts) or not sizes.max():
        return found
    starts = np.cumsum(sizes + 1) - sizes
    top = max(int(t.max()) for t in texts if len(t)) + 1
    words = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    # A word that occurs once before each text and at the end; no stretch of equal words crosses it.
    edges = np.append(starts - 1, len(words) - 1)
    words[edges] = top + np.arange(len(edges))
    for start, text in zip(starts, texts, strict=True):
        words[start : start + len(text)] = text
    parts = list(_candidates(words, starts, sizes))
    if not parts:
        return found
    text, i, q = (np.concatenate(x) for x in zip(*parts, strict=True))

    least = np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    pad = np.concatenate([words, top + len(edges) + np.arange(2 * MODULUS)])
    right, right_open = direct(pad, i, i + q, i % MODULUS, q % MODULUS)
    # To the left from i - 1: the same to the right in the reversed array.
    mirror = len(words) - 1
    back = np.concatenate([words[::-1], pad[len(words) :]])
    ri, rj = mirror - (i + q - 1), mirror - (i - 1)
    left, left_open = direct(back, ri, rj, ri % MODULUS, q % MODULUS)
    kept = right_open | left_open | (left + right + q >= least)
    text, i, q, least, right, left = (x[kept] for x in (text, i, q, least, right, left))
    right_open, left_open = right_open[kept], left_open[kept]
    if not len(text):
        return found

    # Sampled suffixes of those texts alone that an extension asks for.
    asked = np.unique(text[right_open | left_open])
    if len(asked):
        lengths = sizes[asked] + 1
        offsets = np.cumsum(lengths) - lengths
        cut = np.concatenate([words[starts[t] - 1 : starts[t] + sizes[t]] for t in asked])
        cut = np.append(cut, words[-1])
        shift = np.zeros(len(texts), np.int64)
        shift[asked] = offsets - (starts[asked] - 1)
        if right_open.any():
            at = np.flatnonzero(right_open)
            here = i[at] + shift[text[at]]
            right[at] = Extensions(cut).of(here, here + q[at])
        if left_open.any():
            at = np.flatnonzero(left_open)
            here = i[at] + shift[text[at]] - 1
            end = len(cut) - 1
            left[at] = Extensions(cut[::-1]).of(end - here - q[at], end - here)

    long_enough = left + right + q >= least
    text, q = text[long_enough], q[long_enough]
    start = (i - left)[long_enough]
    length = (left + right)[long_enough] + q
    # A stretch found under several periods: its smallest one divides the others.
    order = np.lexsort((q, length, start, text))
    text, start, length, q = (x[order] for x in (text, start, length, q))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = (x[new] for x in (text, start, length, q))
    order = np.lexsort((q, start, text))
    rows = np.column_stack([start - starts[text], length, q])[order]
    bounds = np.searchsorted(text[order], np.arange(len(texts) + 1))
    for t in np.unique(text):
        found[t] = rows[bounds[t] : bounds[t + 1]]
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def _batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    coded = [
        np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        for words in texts
    ]
    runs = find(coded)
    collapsed = []
    for words, found in zip(texts, runs, strict=True):
        if len(found):
            words = [words[k] for k in np.flatnonzero(kept_words(len(words), found))]
        collapsed.append(b" ".join(words))
    rows = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    listed = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], ["start", "length", "period"]
        ),
    )
    return pa.record_batch(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(words) for words in texts], pa.int64()),
            listed,
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed text per row.

    Words are runs of characters that are not ASCII white space, numbered from 0; the collapsed text
    joins the words that stay by one space. A null or empty text, or one of white space alone, has no
    words, no runs and an empty collapsed text. Whole texts of any length are one problem each;
    memory grows with the longest text. Repeated rows give one row each, a null doc_id stays null,
    other columns are not read, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes.split() parts at exactly the six ASCII white-space bytes.
                words = text.as_buffer().to_pybytes().split()
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield _batch(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield _batch(ids, texts)

    return common.id_and_text(docs).mapInArrow(
        run,
        "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
        "collapsed string",
    )
