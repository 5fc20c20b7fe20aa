"""Personal data in texts, plain or disguised, always as spans of the source text.

Plain finds come from fixed patterns. For disguised ones a cascade of transducers rewrites the text
and keeps the way back:

1. characters that look like ASCII (other scripts, wide and mathematical forms) become it, one for
   one; characters without width vanish;
2. `(at)`, `[dot]`, ` at `, ` dot ` and their kin become the sign, with the space around them;
3. spelled digits in a row become digits, a spelled plus before digits its sign, and O, o, I, l within
   numbers the digit that they stand for.

The detectors then read the rewritten text. A find counts if something in it was rewritten and it
stands alone, and its ends are mapped back through the rewritten pieces. Every step is linear in the
length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from terraloom.llm import common

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

# Detectors --------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number is tried from its first digit only: a later start meets the same end.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part, which no other @ interrupts, and on over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """Leftmost finds that do not overlap, kind by kind; a find that fails its check is dropped."""
    found = [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


# Transducers ------------------------------------------------------------------------------------

# Letters of other scripts that look like these ASCII letters, and signs.
_LOOK_ALIKES = {
    "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХЅІЈ": "aeopcyxijshdqwABEKMHOPCTYXSIJ",
    "οανρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "oavpABEZHIKMNOPTYX",
    "ıɡ‐‑。｡": "ig--..",
}
# Characters without width.
_NO_WIDTH = "­​‌‍⁠﻿"
# Spelled digits in English, German, French and Spanish.
_DIGITS = {
    "0": "zero null zéro cero",
    "1": "one eins un une uno",
    "2": "two zwei zwo deux dos",
    "3": "three drei trois tres",
    "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco",
    "6": "six sechs seis",
    "7": "seven sieben sept siete",
    "8": "eight acht huit ocho",
    "9": "nine neun neuf nueve",
}
# Words for the two signs.
_AT = "at|arroba|arobase|klammeraffe"
_DOT = "dot|punkt|punto|point"

#: Spelled digits that stand together before they are read as a number.
LEAST_SPELLED = 3


def _folds() -> dict[int, str]:
    """Look-alikes by rule: decimal digits of any script, and forms that decompose to one ASCII sign."""
    table = {}
    for point in chain(range(0xA0, 0x3400), range(0xFE00, 0x10000), range(0x1D400, 0x1D800)):
        char = chr(point)
        kind, _, rest = unicodedata.decomposition(char).partition(" ")
        if unicodedata.category(char) == "Nd":
            table[point] = str(unicodedata.digit(char))
        elif kind in ("<wide>", "<font>", "<noBreak>", "<small>", "<compat>") and " " not in rest:
            if 0x20 <= int(rest, 16) < 0x7F:
                table[point] = chr(int(rest, 16))
    for there, here in _LOOK_ALIKES.items():
        table |= dict(zip(map(ord, there), here, strict=True))
    return table


_FOLDS = _folds()
_FOLDABLE = frozenset(map(chr, _FOLDS)) | frozenset(_NO_WIDTH)
_ASCII = bytes(range(128))
_VANISHING = re.compile(f"[{_NO_WIDTH}]+")
_SPELLED = {word: digit for digit, words in _DIGITS.items() for word in words.split()}
_SPELLED_WORD = re.compile(rf"\b(?i:{'|'.join(sorted(_SPELLED, key=len, reverse=True))})\b")
_BETWEEN = re.compile(rf"(?:[\s().0-9-]|(?i:{_DOT}))*+")
_APART = re.compile(r"[\s-]*+")
_BRACKETED = re.compile(rf"[\[({{<]\s*+(?i:(?P<at>@|{_AT})|(?P<dot>\.|{_DOT}))\s*+[\])}}>]")
_CODED = re.compile(r"&(?:(?P<at>#0*+64|commat)|(?P<dot>#0*+46|period));")
_BARE = re.compile(rf"\s(?i:(?P<at>{_AT})|(?P<dot>{_DOT}))(?=\s)")
_PLUS = re.compile(rf"\b(?i:plus|más)\s++(?=[0-9(]|(?i:{'|'.join(_SPELLED)})\b)")
_MIXED = re.compile(r"[0-9](?:[OoIl]|(?<=[OoIl][0-9]))")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]++(?![A-Za-z0-9])")
_AS_DIGITS = str.maketrans("OoIl", "0011")


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 0x20 for b in range(256))


def _bytes(words: Iterable[str]) -> frozenset[bytes]:
    """Of each word the longest piece that `_tokens` leaves of it."""
    return frozenset(max(w.encode().translate(_PLAIN).split(), key=len) for w in words)


_SPELLED_TOKENS = _bytes(_SPELLED)
_SIGN_TOKENS = _bytes([*_AT.split("|"), *_DOT.split("|")])
_PLUS_TOKENS = _bytes(["plus", "más"])
_WATCHED = _SPELLED_TOKENS | _SIGN_TOKENS | _PLUS_TOKENS


def _tokens(text: str) -> list[bytes]:
    """Runs of ASCII letters, cheaply: what the slower patterns look for must be among them."""
    return text.encode().translate(_PLAIN).split()


class Rewritten:
    """A text after edits (start, end, replacement, what), with the way back to its source."""

    def __init__(self, source: str, edits: list[tuple[int, int, str, str]]):
        self.edits: list[tuple[int, int, str, str]] = []
        parts, self._starts, self._pieces = [], [], []
        at = length = 0

        def add(piece: str, start: int, end: int, copied: bool) -> int:
            if piece:
                parts.append(piece)
                self._starts.append(length)
                self._pieces.append((start, end, copied))
            return length + len(piece)

        for edit in sorted(edits):
            start, end, replacement, _ = edit
            if start < at:
                continue
            length = add(source[at:start], at, start, True)
            length = add(replacement, start, end, False)
            self.edits.append(edit)
            at = end
        length = add(source[at:], at, len(source), True)
        self.text = "".join(parts)
        self._ends = [e[1] for e in self.edits]

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        def piece(place: int) -> tuple[int, int, int, bool]:
            k = bisect_right(self._starts, place) - 1
            return (self._starts[k], *self._pieces[k])

        first, begin, _, copied = piece(start)
        low = begin + start - first if copied else begin
        first, begin, stop, copied = piece(end - 1)
        high = begin + end - first if copied else stop
        return low, high

    def edits_within(self, start: int, end: int) -> list[tuple[int, int, str, str]]:
        found, k = [], bisect_right(self._ends, start)
        while k < len(self.edits) and self.edits[k][0] < end:
            found.append(self.edits[k])
            k += 1
        return found


def _spaced(text: str, start: int, end: int, floor: int) -> tuple[int, int]:
    """The range with the white space around it, not before `floor`."""
    while start > floor and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    return start, end


def _sign_edits(text: str, spelled: bool) -> Iterator[tuple[int, int, str, str]]:
    patterns = [(_BRACKETED, "marked"), (_CODED, "marked"), *[(_BARE, "bare")] * spelled]
    for pattern, what in patterns:
        floor = 0
        for m in pattern.finditer(text):
            sign = "@" if m.lastgroup == "at" else "."
            start, end = _spaced(text, *m.span(), floor)
            floor = end
            yield start, end, sign, what


def _spelled_edits(text: str) -> Iterator[tuple[int, int, str, str]]:
    words = list(_SPELLED_WORD.finditer(text))
    first = 0
    for k in range(1, len(words) + 1):
        if k < len(words) and _BETWEEN.fullmatch(text, words[k - 1].end(), words[k].start()):
            continue
        row, first = words[first:k], k
        if len(row) < LEAST_SPELLED:
            continue
        before = None
        for m in row:
            start = m.start()
            if before is not None and _APART.fullmatch(text, before, start):
                start = before
            yield start, m.end(), _SPELLED[m[0].lower()], "digit"
            before = m.end()


def _mixed_edits(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _NUMBER.finditer(text):
        digits = m[0].translate(_AS_DIGITS)
        if digits != m[0] and not m[0].isalpha():
            yield m.start(), m.end(), digits, "digit"


def _edits(text: str, folded: bool) -> list[tuple[int, int, str, str]]:
    edits = [(*m.span(), "", "marked") for m in _VANISHING.finditer(text)] if folded else []
    tokens = _tokens(text)
    watched = not _WATCHED.isdisjoint(tokens)
    edits += _sign_edits(text, watched and not _SIGN_TOKENS.isdisjoint(tokens))
    if watched:
        if sum(map(_SPELLED_TOKENS.__contains__, tokens)) >= LEAST_SPELLED:
            edits += _spelled_edits(text)
        if not _PLUS_TOKENS.isdisjoint(tokens):
            edits += [(*m.span(), "+", "digit") for m in _PLUS.finditer(text)]
    if _MIXED.search(text):
        edits += _mixed_edits(text)
    return edits


def _plausible_email(found: str, source: str, edits: list[tuple[int, int, str, str]]) -> bool:
    """Whether a rewritten find is an address: bare words alone must not make one of prose."""
    local, _, domain = found.partition("@")
    last = domain.rpartition(".")[2]
    if not (last.isalpha() and len(last) > 1) or local[0] == "." or local[-1] == ".":
        return False
    if any(what == "marked" for *_, what in edits) or not edits:
        return True
    bare_dots = sum(sign == "." for _, _, sign, what in edits if what == "bare")
    if "@" in source:
        # Only a domain whose dots are all spelled: `a@b.org point final` is an address and a word.
        behind = source.rpartition("@")[2]
        return "." not in behind and bare_dots > 0
    return bare_dots > 0 or any(c in "0123456789._" for c in local)


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Finds in the rewritten text that rewriting has made, as spans of `text`."""
    beyond_ascii = text.encode().translate(None, _ASCII).decode()
    foldable = not _FOLDABLE.isdisjoint(beyond_ascii)
    folded = text.translate(_FOLDS) if foldable else text
    edits = _edits(folded, foldable)
    if not edits and not foldable:
        return []
    normal = Rewritten(folded, edits)
    found = []
    for kind, start, end in detect(normal.text):
        low, high = normal.source_span(start, end)
        inside = normal.edits_within(low, high)
        if not inside and text[low:high] == folded[low:high]:
            continue
        around = normal.text[start - 1 : start] + normal.text[end : end + 1]
        if any(c.isalnum() for c in around):
            continue
        if kind == "email" and not _plausible_email(normal.text[start:end], folded[low:high], inside):
            continue
        found.append((kind, low, high))
    return found


def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) by start, kind and end, in code points, ends exclusive."""
    base = detect(text)
    plain = set(base)
    added = set(disguised(text)) - plain
    spans = [(*s, True) for s in base] + [(*s, False) for s in added]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]
)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, base) of every row, in code points of the whole text.

    `base` marks what the plain patterns find; the rest is disguised. A null or empty text has no
    spans. Texts of any length are read whole. Repeated rows give one row each, a null doc_id stays
    null, other columns are not read, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.arrow_rows(batches, 1000):
            offsets, rows = [0], []
            for text in batch.column(1).to_pylist():
                rows += spans_of(text)
                offsets.append(len(rows))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            fields = [pa.array(c, f.type) for c, f in zip(columns, _SPAN, strict=True)]
            spans = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_SPAN))
            )
            yield pa.record_batch([batch.column(0), spans], ["doc_id", "spans"])

    return common.id_and_text(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")
