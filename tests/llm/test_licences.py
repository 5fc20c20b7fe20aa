"""Licence statements and their inheritance against brute force."""

import math
from collections import Counter

import pytest
from corpus_rows import ROWS
from pyspark.sql import functions as F

from terraloom.llm import licences

FILES = [
    (1, "LICENSE", "Licensed under the Apache License, Version 2.0.\nmore"),
    (2, "a/LICENSE.txt", "x\nReleased under the MIT License."),
    (3, "a/b/one.py", "code"),
    (4, "a/b/two.py", "Licensed under CC BY-NC 4.0.\ncode"),
    (5, "c/d/e/three.py", None),
    (6, "ab/four.py", "a license is mentioned here among other words of a long line"),
    (7, None, "This work is licensed under the GNU General Public License, version 3."),
    (8, None, ""),
    (9, "a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (10, "five.py", ""),
    (10, "five.py", ""),
]


def brute_force(files):
    words = {w for texts in licences.TEMPLATES.values() for t in texts for w in licences.tokens(t)}
    held = Counter(w for _, _, text in files for w in words & set(licences.tokens(text or "")))
    n = len(files)

    def vector(line):
        out = Counter()
        for word, times in Counter(licences.tokens(line)).items():
            if word in words:
                out[word] = (1 + math.log(times)) * (math.log((1 + n) / (1 + held[word])) + 1)
            else:
                out["other " + word] = times * (math.log((1 + n) / 2) + 1)
        return out

    def cosine(x, y):
        dot = sum(x[w] * y[w] for w in x)
        return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    own = {}
    for place, (_, _, text) in enumerate(files):
        best = None
        for line in (text or "").split("\n"):
            for name, texts in licences.TEMPLATES.items():
                for t in texts:
                    near = cosine(vector(line), vector(t)) if licences.tokens(line) else 0
                    if near >= licences.NEAR and (best is None or near > best[1] + 1e-9):
                        best = (name, near)
        own[place] = best
    grants = {}
    for place, (doc_id, path, _) in enumerate(files):
        last = path and path.rpartition("/")[2].lower()
        if own[place] and path and last.startswith(("license", "licence", "copying")):
            folder = path.rpartition("/")[0]
            grants[folder] = min(grants.get(folder, (path, doc_id, own[place])), (path, doc_id, own[place]))
    out = []
    for place, (doc_id, path, _) in enumerate(files):
        if own[place]:
            out.append((doc_id, path, own[place][0], round(own[place][1], 6), "own"))
            continue
        folder, found = path and path.rpartition("/")[0], None
        while path is not None and found is None:
            found = grants.get(folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        out.append((doc_id, path, found and found[2][0], found and round(found[2][1], 6), found and "inherited"))
    return sorted(out, key=str)


def test_scan_equals_brute_force(spark):
    frame = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumn("above", F.lit(1))
    found = licences.scan(frame, F.col("path")).withColumn("cosine", F.round("cosine", 6))
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(FILES)


@pytest.mark.parametrize("name", sorted(licences.TEMPLATES))
def test_templates_find_themselves_and_hold_a_hint(name):
    match = licences.Matcher({}, 100)
    for text in licences.TEMPLATES[name]:
        assert licences.HINT.search(text)
        assert match(text) == (name, pytest.approx(1.0))


def test_edge_rows(docs, no_docs):
    path = F.concat_ws("/", "source", "doc_id")
    assert licences.scan(docs, path).count() == len(ROWS)
    assert licences.scan(no_docs, path).count() == 0
