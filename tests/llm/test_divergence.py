"""The audit against plain loops over exact integers, and the transducer against a sorted list."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_rows import ROWS

from terraloom.llm import divergence
from terraloom.llm.transducer import Transducer


def looked_up(transducer, words):
    offsets = np.cumsum([0, *map(len, words)])
    return transducer.ordinals(np.frombuffer(b"".join(words) + b"\0", np.uint8), offsets).tolist()


def test_ordinals_are_places_in_the_sorted_list():
    draw = random.Random(1)
    terms = sorted({bytes(draw.choice(b"ab\xc3\xff") for _ in range(draw.randrange(1, 9))) for _ in range(900)})
    transducer = Transducer.from_bytes(Transducer.of(terms).to_bytes())
    others = [t + b"a" for t in terms] + [t[:-1] for t in terms] + [b"", b"z", b"a" * 100_000]
    place = {t: k for k, t in enumerate(terms)}
    words = terms + others
    assert looked_up(transducer, words) == [place.get(w, -1) for w in words]


def test_the_transducer_is_minimal():
    # All words of three letters from ab: one state a level, and the root.
    terms = sorted(bytes([a, b, c]) for a in b"ab" for b in b"ab" for c in b"ab")
    assert len(Transducer.of(terms).finals) == 4
    rights = Transducer.of([b"cat", b"cats", b"rat", b"rats"])
    assert len(rights.finals) == 5
    with pytest.raises(ValueError, match="ascend"):
        Transducer.of([b"b", b"a"])


def test_empty_vocabularies():
    assert looked_up(Transducer.of([]), [b"", b"a"]) == [-1, -1]
    assert looked_up(Transducer.of([b""]), [b"", b"a"]) == [0, -1]


def plain_audit(rows):
    words = [
        (lang or "", source or "", [
            t.translate({k: k + 32 for k in range(65, 91)})
            for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        ])
        for text, lang, source in rows
    ]
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in words:
        groups[lang].add(source)
        docs.update({(lang, t) for t in terms})
        counts[lang, source].update(terms)
    found = set()
    for lang, sources in groups.items():
        kept = sorted(t for (own, t), n in docs.items() if own == lang and n >= 3)
        v = len(kept)

        def shares(per_term, kept=kept, v=v):
            total = sum(per_term[t] for t in kept)
            return [1 + 10**9 * (per_term[t] + 1) // (total + v) for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            values = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[t], strict=True)), t.encode())
                      for t in sources if t != s]
            for rank, (value, item) in enumerate(sorted(values), 1):
                found.add((lang, s, "pair", item.decode(), -value, rank))
            values = [(-((a - b) ** 2 // b), t.encode()) for a, b, t in zip(p[s], q, kept, strict=True)
                      if counts[lang, s][t] and a > b]
            for rank, (value, item) in enumerate(sorted(values)[:200], 1):
                found.add((lang, s, "term", item.decode(), -value, rank))
    return found


def rows_of(audited):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in audited.collect()}


def test_audit_of_troubled_rows(docs, no_docs):
    found = rows_of(divergence.audit(docs))
    assert found == plain_audit([r[1:] for r in ROWS])
    assert {r[2] for r in found} == {"pair", "term"}
    assert divergence.audit(no_docs).count() == 0


@pytest.fixture(scope="module")
def random_rows():
    draw = random.Random(9)
    vocabulary = [f"wört{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'x' * (k % 5)}" for k in range(700)]
    rows = []
    for _ in range(400):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "ç", None, "z"])
        n = draw.choice([0, 3, 30, 80])
        text = " ".join(vocabulary[int(draw.random() ** 3 * 700)] for _ in range(n))
        rows.append((text.upper() if draw.random() < 0.2 else text, lang, source))
    return [*rows, ("solo", "xx", "only"), (None, "yy", "a"), (None, "yy", "b")]


def test_audit_equals_plain_loops(spark, random_rows, monkeypatch):
    docs = spark.createDataFrame(random_rows, "text string, lang string, source string")
    expected = plain_audit(random_rows)
    assert len({r for r in expected if r[2] == "term" and r[5] == 200}) > 0
    assert rows_of(divergence.audit(docs)) == expected
    # Small chunks, shards and batches change nothing.
    for name, value in (("SHARD_TERMS", 7), ("CHUNK_TERMS", 50), ("BATCH_PAIRS", 11)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.audit(docs.repartition(5))) == expected


def test_shares_are_exact(spark):
    draw = random.Random(8)
    rows = [(n := draw.randrange(10**draw.randrange(1, 16)), n + draw.randrange(1, 10**6)) for _ in range(500)]
    table = spark.createDataFrame([*rows, (0, 1)], "n long, size long")
    found = table.select("n", "size", divergence.share(table["n"], table["size"]).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.size for r in found)


def test_pair_and_term_parts_have_no_nested_loops(docs):
    plan = divergence.audit(docs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
