"""Periodic runs against plain comparison of every period, on numbers and through the table."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from corpus_rows import ROWS, python_words
from pyspark.sql import functions as F

from terraloom.llm import periodic_runs, queries


def plain_runs(words):
    """Per period all maximal stretches of equal pairs; a stretch keeps its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            if at - start + q >= max(6, 4 * q):
                found.setdefault((start, at - start + q), q)
            at += 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(draw, n, kinds):
    words = [draw.randrange(kinds) for _ in range(n)]
    if n > 5:
        a, p = draw.randrange(n), draw.randrange(1, max(2, n // 4 + 1))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if draw.random() < 0.5:
            words[draw.randrange(n)] = 99
    return words


def test_runs_equal_plain_comparison():
    draw = random.Random(5)
    for _ in range(120):
        texts = [
            periodic(draw, draw.choice([0, 1, 5, 6, 7, 30, 90, 260]), draw.choice([1, 2, 3, 60]))
            for _ in range(draw.choice([1, 4, 9]))
        ]
        found = periodic_runs.find([np.array(t, np.int64) for t in texts])
        for text, runs in zip(texts, found, strict=True):
            assert [tuple(map(int, r)) for r in runs] == plain_runs(text)


def test_the_grid_in_parts_is_the_same(monkeypatch):
    words = np.array(periodic(random.Random(2), 900, 2), np.int64)
    whole = periodic_runs.find([words])[0]
    monkeypatch.setattr(periodic_runs, "BATCH_PLACES", 50)
    assert (periodic_runs.find([words])[0] == whole).all()


def test_extensions_equal_plain_comparison():
    draw = random.Random(3)
    words = np.array([*periodic(draw, 400, 2), 1000], np.int64)
    i, j = (np.array([draw.randrange(400) for _ in range(3000)]) for _ in range(2))
    i, j = i[i != j], j[i != j]
    found = periodic_runs.Extensions(words).of(i, j)
    for a, b, n in zip(i, j, found, strict=True):
        expected = 0
        while max(a, b) + expected < len(words) and words[a + expected] == words[b + expected]:
            expected += 1
        assert n == expected


def test_the_cover_reaches_every_difference():
    members = set(periodic_runs.COVER)
    for d in range(periodic_runs.MODULUS):
        a = int(periodic_runs._SHIFT[d])
        assert a in members and (a + d) % periodic_runs.MODULUS in members


def test_a_very_long_text():
    words = np.arange(300_000) % 7919
    words[100_000:] = words[100_000:160_000][np.arange(200_000) % 50_000]
    start, length, period = map(int, periodic_runs.find([words])[0][0])
    assert length >= 4 * period
    one = periodic_runs.find([np.zeros(60_000, np.int64)])[0]
    assert one.tolist() == [[0, 60_000, 1]]


def test_collapsed_texts(spark):
    texts = {1: "go " * 9 + "home", 2: "a b a b a b a b c", 3: "x x x x x", 4: " \t", 5: None, 6: "é é é é é é"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in periodic_runs.collapse(docs).collect()}
    assert {k: r.collapsed for k, r in found.items()} == {
        1: "go home", 2: "a b c", 3: "x x x x x", 4: "", 5: "", 6: "é"
    }
    assert [tuple(r) for r in found[2].runs] == [(0, 8, 2)] and found[3].runs == []


def test_troubled_rows(docs, no_docs):
    found = periodic_runs.collapse(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.collapsed) for r in found) == sorted(
        (i is None, i or 0, " ".join(python_words(text))) for i, text, *_ in ROWS
    )
    assert periodic_runs.collapse(no_docs).count() == 0


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    draw = random.Random(11)
    rows = [
        (i, " ".join(f"w{x}" for x in periodic(draw, draw.choice([0, 3, 40, 200]), 40)))
        for i in range(150)
    ]
    folder = str(tmp_path_factory.mktemp("runs"))
    table = spark.createDataFrame([*rows, (None, "a " * 8)], "doc_id long, text string")
    table.withColumn("source", F.lit("s")).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_the_query_equals_the_contract(spark, sf_dir):
    folder, rows = sf_dir
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, folder).collect()}
    assert len(found) == len(rows) + 1
    for doc_id, text in rows:
        words = text.split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = found[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
