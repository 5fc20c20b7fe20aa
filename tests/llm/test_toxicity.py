"""Restoration of disguised words, and scores on held-out documents."""

import random
import zlib

import numpy as np
import pytest
from corpus_rows import ROWS

from terraloom.llm import deobfuscation, toxicity

INSULTS = ["idiot", "moron", "stupid", "worthless", "loser", "scum"]
DISGUISED = ["1d10t", "m0r0n", "s t u p i d", "w0rthl3ss", "l.o.s.e.r", "looooser", "$cum", "i-d-i-o-t", "stuuupid"]


@pytest.fixture(scope="module")
def planted(spark):
    """Plain documents, one in four with insults; disguised ones get no label."""
    draw = random.Random(1)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    rows, marks = [], []
    for i in range(1200):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(40)]
        toxic = i % 4 == 0
        for insult in draw.sample(INSULTS, 3) if toxic else ():
            words.insert(draw.randrange(40), insult)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    for n, word in enumerate(DISGUISED):
        rows.append((5000 + n, f"the reader of this and {word} in the ones"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int"), dict(marks)


@pytest.fixture(scope="module")
def restore(planted):
    counts = deobfuscation.trigram_counts(planted[0])
    return deobfuscation.Restorer(deobfuscation.language_model(counts))


def test_trigram_counts_equal_loops(spark):
    texts = ["Ab, c", None, "é1é", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = deobfuscation.trigram_counts(docs)
    code = {c: i for i, c in enumerate(deobfuscation.LETTERS, 1)}
    expected = np.zeros_like(counts)
    for text in texts:
        codes = [0]
        for c in (text or "").lower() + " ":
            if code.get(c, 0) or codes[-1]:
                codes.append(code.get(c, 0))
        for gram in zip(codes, codes[1:], codes[2:]):
            expected[gram] += 1
    # Texts share their boundary, so only trigrams inside words are equal.
    assert (counts[:, 1:, :] == expected[:, 1:, :]).all()


@pytest.mark.parametrize("text", ["", "plain words, here.", "a b thing", "4790808788808394", "192.168.3.4", "word&&& the$$$"])
def test_plain_text_stays(restore, text):
    assert restore(text) == text


def test_disguised_words_are_restored(restore):
    for word in DISGUISED:
        assert any(insult in restore(f"the {word} of") for insult in INSULTS), word


def test_best_path_equals_all_paths(restore):
    """The lattice search against every path."""

    def paths(lattice, place, out, cost):
        if place == len(lattice):
            yield out, cost
            return
        for letters, extra, to in lattice[place]:
            yield from paths(lattice, to, out + letters, cost + extra)

    def score(out, cost):
        total, p, q = -cost, 0, 0
        for letter in [*out, None]:
            code = deobfuscation._CODE.get(letter, 0)
            if not (code == 0 and q == 0):
                total += restore.model[p][q][code]
            p, q = q, code
        return total

    for span in ["1d10t", "heee1", "t h 3", "a$$", "00oo0"]:
        best = max(score(*x) for x in paths(restore.arcs(span), 0, "", 0.0))
        assert max(score(o, c) for o, c in paths(restore.arcs(span), 0, "", 0.0) if o == restore.decode(span)) == pytest.approx(best)


def test_held_out_documents(planted):
    docs, labels, marks = planted
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert all(rows[i].predicted == mark for i, mark in marks.items() if rows[i].held_out)
    assert all(rows[5000 + n].predicted == 1 for n in range(len(DISGUISED)))


def test_held_out_labels_are_never_learned(spark, planted):
    docs, labels, marks = planted
    turned = labels.withColumn(
        "toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"])
    )
    first = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert {r.doc_id: r.score for r in toxicity.score(docs, turned).collect()} == first


def test_edge_rows(docs, no_docs, labels):
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r.score == pytest.approx(toxicity.UNEXPLAINED) for r in rows)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == len(ROWS)
