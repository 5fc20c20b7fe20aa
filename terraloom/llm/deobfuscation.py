"""Noisy-channel restoration of disguised words: a character lattice and its best path.

The channel writes letters as look-alikes, repeats them and puts separators between them. A span
that may be so disguised becomes a lattice of what could have been meant; the path with the best
sum of channel costs and character-trigram log probabilities replaces it. Everything else is a
lattice with a single path, which stands for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import common

#: Letters of the language model; every other character is a boundary, class 0.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüÿœ"
CLASSES = len(LETTERS) + 1

#: What a look-alike can stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t",
}
#: Look-alikes that also stand as decoration, three or more equal ones in a row.
SIGNS = "@$!|+"
#: Costs in nats: a look-alike read as a letter or kept as it is; a separator between single
#: characters dropped or kept.
READ, KEPT, DROPPED, PARTED = 1.0, 8.0, 0.5, 4.0
_CLASS = np.zeros(1 << 16, np.uint8)
for _place, _letter in enumerate(LETTERS, 1):
    _CLASS[ord(_letter)] = _place
    if len(_letter.upper()) == 1:
        _CLASS[ord(_letter.upper())] = _place
_CODE = {letter: place for place, letter in enumerate(LETTERS, 1)}

_L = f"[{LETTERS}]"
#: A word with a look-alike beside a letter; !, | and + count between letters only.
_LEET = re.compile(
    rf"(?<![{LETTERS}0-9@$])(?=[0-9@$!|+]*{_L})(?={_L}*[0134578@$!|+])"
    rf"[{LETTERS}0-9@$]+(?:([!|+])\1*(?={_L})[{LETTERS}0-9@$]+)*"
)
#: Three or more of one letter in a row.
_LONG = re.compile(rf"(?<!{_L}){_L}*?({_L})\1\1{_L}*")
#: Single characters with one separator between each two; by itself as a token, or over tokens.
_SINGLE = f"[{LETTERS}0134578@$!|+]"
_DOTTED = re.compile(rf"(?<![^\"'(])(?=\S*{_L}\S*{_L}){_SINGLE}([._*-])(?:{_SINGLE}\1){{1,}}{_SINGLE}(?=[.,;:?!]*$)")
#: Tokens without any of these restore to themselves.
_SUSPECT = re.compile(r"[0134578@$!|+]|(.)\1\1|.[._*-].[._*-]")
#: Runs by what single tokens are: in the alphabet, in it with punctuation after it, or neither.
_RUN = re.compile("s{2,}e|s{3,}")
_ONE = re.compile(_SINGLE)
_END = re.compile(rf"({_SINGLE})[.,;:?!]+")


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts, as an array of CLASSES x CLASSES x CLASSES.

    Counted in the tasks and summed by Spark; what arrives is bounded by the alphabet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in common.arrow_rows(batches, 500):
            text = "\n".join(["", *batch.column(0).to_pylist(), ""])
            points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            codes = _CLASS[np.minimum(points, 0xFFFF)].astype(np.int32)
            # One boundary for any run of them.
            codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]
            index = (codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:]
            total += np.bincount(index, minlength=len(total))
        (seen,) = np.nonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], ["gram", "n"])

    counted = docs.select(common.text_of(docs).alias("text")).mapInArrow(run, "gram long, n long")
    rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**3)
    counts[rows["gram"].to_numpy(int)] = rows["n"].to_numpy(float)
    return counts.reshape(CLASSES, CLASSES, CLASSES)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a character after two others: trigrams over bigrams over letters."""
    single = counts.sum((0, 1)) + 1
    single = single / single.sum()
    double = counts.sum(0) + 8 * single
    double = double / double.sum(1, keepdims=True)
    triple = counts + 8 * double[None]
    return np.log(triple / triple.sum(2, keepdims=True)).astype(np.float32)


class Restorer:
    """Restores lower-cased texts; tokens and spans decoded before are remembered."""

    REMEMBERED = 300_000

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.known: dict[str, str] = {}

    def __call__(self, text: str) -> str:
        """The restored text, with its white space made single."""
        return " ".join(self.tokens(text))

    def tokens(self, text: str) -> list[str]:
        raw = text.split()
        spaced = self.spaced(raw)
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        known = self.known
        for token in set(raw).difference(known):
            known[token] = self.token(token)
        out: list[str] = []
        at = 0
        for start, end, span in spaced:
            out += map(known.__getitem__, raw[at:start])
            out.append(span)
            at = end
        return out + list(map(known.__getitem__, raw[at:]))

    def spaced(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """Runs of single characters: start, end, and what they restore to."""
        kinds = "".join(
            [
                "s" if len(t) == 1 and _ONE.fullmatch(t) else "e" if len(t) > 1 and _END.fullmatch(t) else "."
                for t in tokens
            ]
        )
        found = []
        for run in _RUN.finditer(kinds) if "ss" in kinds else ():
            start, end = run.span()
            found.append((start, end, self.decode(" ".join(t[0] for t in tokens[start:end]))))
        return found

    def token(self, token: str) -> str:
        if not _SUSPECT.search(token):
            return token
        for pattern in (_DOTTED, _LEET, _LONG):
            token = pattern.sub(self._span, token)
        return token

    def _span(self, match: re.Match) -> str:
        return self.decode(match[0])

    def arcs(self, span: str) -> list[list[tuple[str, float, int]]]:
        """From each place: what may have been meant, its cost, and the place it leads to."""
        spaced = len(span) > 2 and not any(c.isalnum() for c in span[1::2])
        lattice: list[list[tuple[str, float, int]]] = []
        ends = [len(span)] * (len(span) + 1)  # where the run of equal characters ends
        for place in range(len(span) - 2, -1, -1):
            ends[place] = ends[place + 1] if span[place] == span[place + 1] else place + 1
        for place, char in enumerate(span):
            if spaced and place % 2:
                lattice.append([("", DROPPED, place + 1), (" ", PARTED, place + 1)])
                continue
            after = ends[place]
            run = after - place
            meant = [(c, READ) for c in LOOK_ALIKES.get(char, "")]
            meant.append((char, KEPT if char in LOOK_ALIKES else 0.0))
            ways = []
            for letter, cost in meant:
                ways.append((letter, cost, place + 1))
                if run > 2 and letter in _CODE:  # a drawn-out letter was one or two
                    ways += [(letter, cost, after), (letter * 2, cost, after)]
            if run > 2 and char in SIGNS:  # or decoration, as likely as a letter
                ways.append((char * run, READ, after))
            lattice.append(ways)
        return lattice

    def decode(self, span: str) -> str:
        lattice = self.arcs(span)
        model = self.model
        # What was written is a chain of pieces, so that long spans take time in proportion.
        best: list[dict[tuple[int, int], tuple[float, tuple | None]]] = [{} for _ in range(len(span) + 1)]
        best[0][0, 0] = (0.0, None)
        for place, ways in enumerate(lattice):
            for (x, y), (score, out) in best[place].items():
                for letters, cost, to in ways:
                    total, p, q = score - cost, x, y
                    for letter in letters:
                        code = _CODE.get(letter, 0)
                        if not (code == 0 and q == 0):
                            total += model[p][q][code]
                        p, q = q, code
                    held = best[to].get((p, q))
                    if held is None or total > held[0]:
                        best[to][p, q] = (total, (out, letters))
        ends = [
            (score + (model[x][y][0] if y else 0.0), out)
            for (x, y), (score, out) in best[len(span)].items()
        ]
        _, out = max(ends, key=lambda end: end[0])
        pieces = []
        while out is not None:
            out, letters = out
            pieces.append(letters)
        return "".join(reversed(pieces))
