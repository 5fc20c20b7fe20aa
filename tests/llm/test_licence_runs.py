"""Wrapped headers, whole licence files and titles; runs of lines against all runs."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from terraloom.llm import licences

#: As in a corpus where the words of licences are rare.
MATCH = licences.Matcher({}, 10_000)


def by_all_runs(text):
    lines, best = text.split("\n"), None
    for start in range(len(lines)):
        for end in range(start + 1, len(lines) + 1):
            found = MATCH("\n".join(lines[start:end]))
            if found and (best is None or found[1] > best[1] + licences.EQUAL):
                best = found
    return best


def wrapped(text, before=""):
    return "\n".join(textwrap.wrap(text, 40, initial_indent=before, subsequent_indent=before))


def mixed_files():
    draw = random.Random(4)
    prose = ["the of and this", "code = other + 1", "", "a licence is mentioned", "one two three four five six"]
    texts = [t for name in licences.NAMES for t in licences.STATEMENTS[name]] + [licences.full_text("MIT")]
    for _ in range(40):
        parts = [wrapped(draw.choice(texts), draw.choice(["", "# ", " * "])) for _ in range(draw.randint(0, 2))]
        lines = "\n".join([*parts, *draw.choices(prose, k=draw.randint(0, 5))]).split("\n")
        at = draw.randrange(len(lines))
        if draw.random() < 0.5:
            lines[at:at] = draw.choices(prose, k=2)
        if draw.random() < 0.3:
            del lines[at]
        yield "\n".join(lines)


def test_nearest_run_equals_all_runs():
    files = list(mixed_files())
    expected = [by_all_runs(text) for text in files]
    assert 10 < sum(x is not None for x in expected) < 40
    for text, best in zip(files, expected):
        found = MATCH.nearest(text)
        assert (found and found[0]) == (best and best[0]), text
        assert (found and found[1]) == (best and pytest.approx(best[1])), text


@pytest.mark.parametrize("name", licences.NAMES)
def test_whole_licence_files_state_their_licence(name):
    text = licences.full_text(name)
    noted = "\n\nCopyright (c) 2021 Somebody Else\n\n" + "\n".join(textwrap.wrap(text, 60)) + "\nother words\n" * 3
    assert MATCH.nearest(text) == (name, pytest.approx(1.0))
    assert MATCH.nearest(noted)[0] == name and MATCH.nearest(noted)[1] > 0.9


def test_lines_without_hints_equal_brute_force(spark):
    draw = random.Random(9)
    lines = ["under CC BY 4.0", "under CC BY-NC 4.0.", "is hereby granted, free of charge, to any person obtaining a copy"
             " of this software and associated documentation files", "Apache, Version 2.0, January 2004", "by 4.0 and 3.0"]  # fmt: skip
    words = [w for texts in licences.STATEMENTS.values() for t in texts for w in t.split()]
    words = [w for w in words if not licences.HINT.search(w)]
    lines += [" ".join(draw.sample(words, draw.randint(2, 8))) for _ in range(200)]
    lines += ["plain words"] * 5000  # so that the words of licences are rare
    assert not any(map(licences.HINT.search, lines))
    files = [(i, f"f/{i}", line) for i, line in enumerate(lines)]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string")
    found = {r.doc_id: r for r in licences.scan(frame, F.col("path"), lambda _: F.lit(True)).collect()}
    match = licences.Matcher(*licences.document_frequencies(frame))
    assert found[0].licence == "CC-BY-4.0" and found[1].licence == "CC-BY-NC-4.0" and found[2].licence == "MIT"
    for i, line in enumerate(lines):
        best = match(line)
        own = (found[i].licence, pytest.approx(found[i].cosine)) if found[i].origin == "own" else None
        assert own == best, line
    assert sum(match(line) is not None for line in lines) >= 3


def test_wrapped_headers_and_titles_are_found_and_inherited(spark):
    bsd = wrapped(licences.STATEMENTS["BSD-3-Clause"][2])
    header = "#!/bin/sh\n" + wrapped(licences.STATEMENTS["GPL-3.0"][2], "# ") + "\nset -e\necho code"
    files = [(1, "a/LICENSE", bsd), (2, "a/b.py", "code"), (3, "c/d.sh", header), (4, "e/LICENSE", "MIT License\n\nmore")]
    files += [(10 + i, f"f/{i}", "plain words") for i in range(200)]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string")
    found = {r.doc_id: (r.licence, r.origin) for r in licences.scan(frame, F.col("path")).collect()}
    assert found[1] == ("BSD-3-Clause", "own") and found[2] == ("BSD-3-Clause", "inherited")
    assert found[3] == ("GPL-3.0", "own") and found[4] == ("MIT", "own") and found[10] == (None, None)
