"""Long, repetitive and licence-heavy files: all runs count, in time that grows with the lines."""

import random
import time

import pytest
from test_licence_runs import MATCH, by_all_runs, wrapped

from terraloom.llm import licences

TEXTS = [t for name in licences.NAMES for t in licences.STATEMENTS[name]]


def blurred(draw, text, share):
    words = ["foo", "bar", "licence", "the"]
    return "\n".join(
        " ".join(draw.choice(words) if draw.random() < share else w for w in line.split())
        for line in text.split("\n")
    )


def test_files_of_several_blocks_of_starts_equal_all_runs():
    draw = random.Random(11)
    long_ones = [t for t in TEXTS if len(t.split()) > 12]
    found = 0
    for _ in range(12):
        parts = ["foo " + blurred(draw, wrapped(draw.choice(long_ones)), 0.1) for _ in range(10)]
        parts += draw.choices(["", "the of and", "code = other + 1"], k=10)
        draw.shuffle(parts)
        text = "\n".join(parts)
        best = by_all_runs(text)
        near = MATCH.nearest(text)
        assert (near and near[0]) == (best and best[0])
        assert (near and near[1]) == (best and pytest.approx(best[1]))
        found += best is not None and best[1] < 1 - licences.EQUAL
    assert found >= 6


@pytest.mark.parametrize(
    "line, cosine",
    [("Released under the MIT License.", 1), ("Released under the License.", 0.894), ("Released under the MIT License today.", 0.923)],
)
def test_many_equal_lines(line, cosine):
    start = time.perf_counter()
    found = MATCH.nearest(f"{line}\n" * 20_000)
    assert found == ("MIT", pytest.approx(cosine, abs=1e-3)) and time.perf_counter() - start < 30


@pytest.mark.parametrize("share", [0, 0.05, 0.2])
def test_many_full_texts(share):
    draw, text = random.Random(3), licences.full_text("GPL-3.0")
    many = "some words\n" + "\n".join(blurred(draw, text, share) for _ in range(10))
    start = time.perf_counter()
    found = MATCH.nearest(many)
    assert found[0] == "GPL-3.0" and time.perf_counter() - start < 30
    assert found[1] >= MATCH.nearest(many[: len(many) // 8])[1] - licences.EQUAL


def test_one_very_long_line():
    text = "the licence of a work " * 100_000
    assert MATCH.nearest(text) is None
    assert MATCH.nearest(f"MIT License\n{text}") == ("MIT", pytest.approx(1.0))
