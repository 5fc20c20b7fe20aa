"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Every run of consecutive lines of a file, from single lines over header blocks to the whole file, is
compared to every template (full licence texts, headers and one-line statements) as a sparse vector
of its words, weighted by inverse document frequencies over all files. A run that is near enough to a
template states that licence; the nearest run of a file counts. Runs are left out only where a bound
shows that they cannot be the nearest. A licence file's statement holds for its directory. A file without a statement of its own
takes the licence of the nearest directory above it that has a licence file: its directory is
unfolded into its ancestors, joined to the directories with a licence, and the deepest one is taken.

Words outside the templates share one slot, which weighs as much as a word found in one file only, so
that running text about a licence is not near a template. The vocabulary is bounded by the templates,
and so is everything that is sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.operators.storage import written

#: Names of the licences; `licence_texts` holds the full text of each.
NAMES = ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT")
#: Short kinds of templates: titles, one-line statements, and the headers of source files.
STATEMENTS = {
    "Apache-2.0": (
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        " in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License"
        " for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": (
        "Creative Commons Attribution 4.0 International Public License",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is"
        " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        " General Public License for more details. You should have received a copy of the GNU"
        " General Public License along with this program. If not, see"
        " https://www.gnu.org/licenses/.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": (
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files",
    ),
}


def full_text(name: str) -> str:
    return (resources.files("terraloom.llm") / "licence_texts" / f"{name}.txt").read_text("utf-8")


#: What files are compared with.
TEMPLATES = {name: (*STATEMENTS[name], full_text(name)) for name in NAMES}
#: Least cosine of a statement.
NEAR = 0.8
#: Each template holds one of these words. Files are not chosen by them: see `Matcher.possible`.
HINT = re.compile("licen[sc]e|permission|redistribution|free software", re.I)

_TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def tokens(line: str) -> list[str]:
    return _TOKEN.findall(line.lower())


def vocabulary() -> list[str]:
    return sorted({t for texts in TEMPLATES.values() for text in texts for t in tokens(text)})


def document_frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """In how many files each word of the templates stands, and how many files there are."""
    listed = set(vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in common.arrow_rows(batches, 500):
            for text in batch.column(0).to_pylist():
                counts.update(listed.intersection(_TOKEN.findall(text.lower())))
                counts[""] += 1
        yield pa.record_batch(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["word", "n"],
        )

    texts = files.select(common.text_of(files).alias("text"))
    rows = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in rows.collect()}
    return found, found.pop("", 0)


#: Cosines that differ by less are equal.
EQUAL = 1e-9
#: Starts that share a bound, and words whose products are held at once.
BLOCK, WORDS = 32, 8192


class Matcher:
    """The nearest template of a text, and the nearest run of its lines."""

    def __init__(self, frequencies: dict[str, int], files: int) -> None:
        self.weight = {w: self._idf(frequencies.get(w, 0), files) for w in vocabulary()}
        self.other = self._idf(1, files)
        self.templates = []
        self.holding: dict[str, list[int]] = {}
        for name, texts in TEMPLATES.items():
            for text in texts:
                vector, norm = self._vector(tokens(text))
                for word in vector:
                    self.holding.setdefault(word, []).append(len(self.templates))
                self.templates.append((name, vector, norm))
        #: Rows by word, the last one for all words outside the templates: the word's weight times that
        #: in each template over the template's norm, and its part of each template's squared norm.
        self.places = {word: place for place, word in enumerate(self.weight)}
        self.weights = np.array(list(self.weight.values()))
        self.share_rows = np.zeros((len(self.places) + 1, len(self.templates)))
        self.part_rows = np.zeros_like(self.share_rows)
        for place, (_, vector, norm) in enumerate(self.templates):
            for word, weight in vector.items():
                row = self.places[word]
                self.share_rows[row, place] = self.weight[word] * weight / norm
                self.part_rows[row, place] = (weight / norm) ** 2

    @staticmethod
    def _idf(found: int, files: int) -> float:
        return math.log((1 + files) / (1 + found)) + 1

    def _vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        """Weights of the words in the vocabulary, and the norm with all others."""
        vector = {}
        others = 0
        for word, times in Counter(words).items():
            weight = self.weight.get(word)
            if weight is None:
                others += times * times
            else:
                vector[word] = (1 + math.log(times)) * weight
        norm = math.sqrt(sum(w * w for w in vector.values()) + others * self.other**2)
        return vector, norm

    def __call__(self, text: str) -> tuple[str, float] | None:
        """Name and cosine of the nearest template to a text as one vector, the first among equals."""
        words = tokens(text)
        vector, norm = self._vector(words)
        sums: Counter = Counter()
        for word, weight in vector.items():
            for place in self.holding[word]:
                sums[place] += weight * self.templates[place][1][word]
        name, cosine = None, 0.0
        for place in sorted(sums):
            near = sums[place] / (norm * self.templates[place][2])
            if near > cosine + 1e-12:
                name, cosine = self.templates[place][0], near
        return (name, cosine) if name is not None and cosine >= NEAR else None

    def possible(self, text: str) -> bool:
        """Whether the words of a text hold enough of a template for any run of it to be near.

        By Cauchy and Schwarz a cosine is at most the root of the part of the template's squared
        norm that belongs to words which both hold.
        """
        held = [self.places[word] for word in self.places.keys() & set(tokens(text))]
        part = self.part_rows[held].sum(axis=0)
        return bool(part.max() >= (NEAR - EQUAL) ** 2)

    def nearest(self, text: str) -> tuple[str, float] | None:
        """Name and cosine of the run of lines that is nearest to a template.

        Among equals the run that starts first counts, then the shortest, then the first template.
        Bounds leave out runs that cannot be it. The product with a template only grows with a run,
        and so does the run's norm: the product of the longest run of a block of starts over the norm
        of its shortest one bounds them all, for every end. Nor is a cosine above the root of that
        part of the template's squared norm whose words the rest of the file holds.
        """
        file = _File(self, text)
        if not len(file.ends):
            return None
        whole = self(text)
        limit = whole[1] if whole else NEAR
        best: tuple[str, float] | None = None
        least = limit - EQUAL  # what a cosine must exceed
        for block, first in enumerate(range(0, len(file.ends), BLOCK)):
            starts = range(first, min(first + BLOCK, len(file.ends)))
            possible = np.sqrt(file.held[block]) >= least
            if not possible.any():
                break  # less is held from line to line
            most = float(file.rest[block][possible].max())
            last = file.last_end(starts, most, least)
            for start in starts:
                found = file.best_end(start, last, most, least)
                file.advance(start, start + 1)
                if found is None:
                    continue
                place, cosine = found
                best, least = (self.templates[place][0], cosine), cosine + EQUAL
                if cosine >= 1 - EQUAL:
                    return best
        return best


class _File:
    """A file's words by number, with what each block of starts has before it."""

    def __init__(self, matcher: Matcher, text: str) -> None:
        lines = [found for found in map(tokens, text.split("\n")) if found]
        numbers = dict(matcher.places)
        words = [numbers.setdefault(word, len(numbers)) for line in lines for word in line]
        self.words = np.array(words, np.int64)
        self.ends = np.cumsum([len(line) for line in lines], dtype=np.int64)
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        #: Which time it is, in the file, that a word stands here; and how often it stood before.
        total = np.bincount(self.words, minlength=len(numbers))
        order = np.argsort(self.words, kind="stable")
        firsts = np.cumsum(total) - total
        self.turn = np.empty(len(words), np.int64)
        self.turn[order] = np.arange(len(words)) - firsts[self.words[order]]
        self.before = np.zeros(len(numbers), np.int64)
        known = len(matcher.places)
        self.listed = np.minimum(self.words, known)  # all other words share a row of zeros
        self.square_of = np.append(matcher.weights**2, matcher.other**2)
        self.shares = matcher.share_rows
        self.other = known
        #: 1 + log n, and 0 for none.
        self.log = np.zeros(int(total.max(initial=0)) + 2)
        self.log[1:] = 1 + np.log(np.arange(1, len(self.log)))
        self._look_ahead(total, matcher.part_rows)

    def _look_ahead(self, total: np.ndarray, parts: np.ndarray) -> None:
        """From each block of starts to the end: products with the templates, parts of them held."""
        edges = self.starts[::BLOCK]
        shape = (len(edges), self.shares.shape[1])
        self.rest, self.held = np.zeros(shape), np.zeros(shape)
        product, held = np.zeros(shape[1]), np.zeros(shape[1])
        high = len(self.words)
        for block in range(len(edges) - 1, -1, -1):
            for low in range(int(edges[block]), high, WORDS):
                some = slice(low, min(low + WORDS, high))
                after = total[self.words[some]] - 1 - self.turn[some]
                rows = self.listed[some]
                product += (self.log[after + 1] - self.log[after]) @ self.shares[rows]
                held += parts[rows[after == 0]].sum(axis=0)
            high = int(edges[block])
            self.rest[block], self.held[block] = product, held

    def advance(self, start: int, end: int, times: int = 1) -> None:
        """Lines from start to end no longer belong to the runs."""
        np.add.at(self.before, self.words[self.starts[start] : self.ends[end - 1]], times)

    def runs(self, start: int):
        """Line numbers, products and norms of the runs from a line, some ends at a time."""
        low, step = int(self.starts[start]), 256
        line = start
        product, square = np.zeros(self.shares.shape[1]), 0.0
        while low < len(self.words):
            high = min(low + step, len(self.words))
            rows, words = self.listed[low:high], self.words[low:high]
            times = self.turn[low:high] - self.before[words]
            old, new = self.log[times], self.log[times + 1]
            other = rows == self.other
            grown = np.where(other, 2.0 * times + 1, new * new - old * old) * self.square_of[rows]
            squares = square + np.cumsum(grown)
            # Products are wanted at the ends of lines: sums by line, then over lines.
            past = int(np.searchsorted(self.ends, high, "right"))
            stops = self.ends[line:past] - low
            cuts = np.concatenate([[0], stops[stops < high - low]])
            sums = np.add.reduceat((new - old)[:, None] * self.shares[rows], cuts, axis=0)
            products = product + np.cumsum(sums, axis=0)
            if len(stops):
                yield np.arange(line, past), products[: len(stops)], np.sqrt(squares[stops - 1])
            product, square = products[-1], float(squares[-1])
            line, low, step = past, high, min(2 * step, WORDS)

    def last_end(self, starts: range, most: float, least: float) -> int:
        """The last line that a run from one of the starts may have to end with."""
        final = last = starts[-1]
        # The norms of the shortest runs, for which more lines are before the run; then back again.
        if len(starts) > 1:
            self.advance(starts[0], final)
        norms = []
        for _, _, some in self.runs(final):
            norms.append(some)
            if most < least * some[-1]:
                break
        if len(starts) > 1:
            self.advance(starts[0], final, -1)
        shortest = np.concatenate(norms)
        for lines, some, _ in self.runs(starts[0]):
            inside = (lines >= final) & (lines < final + len(shortest))
            bounds = some[inside].max(axis=1, initial=0.0)
            near = np.flatnonzero(bounds >= least * shortest[lines[inside] - final])
            if len(near):
                last = int(lines[inside][near[-1]])
            if lines[-1] >= final + len(shortest) - 1:
                break
        return last

    def best_end(self, start: int, last: int, most: float, least: float) -> tuple[int, float] | None:
        """Template and cosine of the nearest run from a line to one up to the last."""
        found = None
        for lines, products, norms in self.runs(start):
            cosines = products.max(axis=1) / norms
            cosines[lines > last] = 0.0
            top = float(cosines.max())
            if top >= NEAR and top > least:
                at = int(np.argmax(cosines >= top - EQUAL))
                row, norm = products[at], norms[at]
                place = int(np.argmax(row >= row.max() - 1e-12 * norm))
                found, least = (place, float(cosines[at])), float(cosines[at]) + EQUAL
            if lines[-1] >= last or most < least * norms[-1]:
                break
        return found


def _statements(frequencies: dict[str, int], files: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(frequencies, files)
        for batch in common.arrow_rows(batches, 500):
            names, cosines = [], []
            for text in batch.column(2).to_pylist():
                best = match.nearest(text) if match.possible(text) else None
                names.append(best and best[0])
                cosines.append(best and best[1])
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(names, pa.string()),
                    pa.array(cosines, pa.float64()),
                ],
                ["doc_id", "path", "licence", "cosine"],
            )

    return run


def directory(path: Column) -> Column:
    """The path up to its last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The directories above a path, from the top (empty) down."""
    parts = F.split(directory(path), "/", -1)
    below = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    return F.array_distinct(F.concat(F.array(F.lit("")), below))


def named_licence(path: Column) -> Column:
    """Whether a path's last part names a licence file."""
    return path.rlike(r"(?i)(^|/)(licen[sc]e|copying)[^/]*$")


def scan(
    files: DataFrame, path: Column, is_licence_file: Callable[[Column], Column] = named_licence
) -> DataFrame:
    """doc_id, path, licence, cosine, origin of every row of `files` (doc_id, text, ...).

    `origin` is 'own' for a statement in the file, 'inherited' for the licence of the nearest
    ancestor directory, and null without either; `cosine` is that of the own or inherited statement.
    Of several licence files of a directory the smallest path counts, then the smallest doc_id. Null
    and empty texts have no statement; a null path inherits nothing. Repeated rows give one row each.
    """
    frequencies, count = document_frequencies(files)
    narrow = files.select(
        files["doc_id"].cast("long").alias("doc_id"),
        path.cast("string").alias("path"),
        common.text_of(files).alias("text"),
    )
    own = narrow.mapInArrow(
        _statements(frequencies, count),
        "doc_id long, path string, licence string, cosine double",
    )
    own = written(own, "licence-statements")
    granted = (
        own.filter("licence is not null and path is not null")
        .filter(is_licence_file(F.col("path")))
        .groupBy(directory(F.col("path")).alias("above"))
        .agg(F.min(F.struct("path", "doc_id", "licence", "cosine")).alias("grant"))
    )
    without = own.filter("licence is null and path is not null")
    # Directories are few beside files: look each one up once, then give its files the result.
    folders = without.select(directory(F.col("path")).alias("folder")).distinct()
    climbed = folders.select("folder", F.posexplode(ancestors(F.concat("folder", F.lit("/x")))).alias("depth", "above"))
    nearest = (
        climbed.join(granted, "above")
        .groupBy("folder")
        .agg(F.max_by("grant", "depth").alias("grant"))
    )
    inherited = without.withColumn("folder", directory(F.col("path"))).join(nearest, "folder", "left")
    rest = inherited.select(
        "doc_id",
        "path",
        F.col("grant.licence").alias("licence"),
        F.col("grant.cosine").alias("cosine"),
        F.when(F.col("grant").isNotNull(), F.lit("inherited")).alias("origin"),
    )
    alone = own.filter("licence is not null or path is null").select(
        "doc_id", "path", "licence", "cosine", F.when(F.col("licence").isNotNull(), F.lit("own")).alias("origin")
    )
    return alone.unionByName(rest)

