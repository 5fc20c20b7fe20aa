"""Plain finds against the contract's patterns, disguised ones against planted spans."""

import hashlib
import random
import re

import pytest
from corpus_rows import ROWS

from terraloom.llm import personal_data, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def plain_finds(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                found.append((kind, *m.span()))
    return found


def test_plain_finds_equal_the_patterns():
    draw = random.Random(4)
    for _ in range(20_000):
        text = "".join(draw.choice("a.@1+- 2(9b%x4") for _ in range(draw.randrange(45)))
        assert personal_data.detect(text) == plain_finds(text), text


DISGUISED = [
    ("email", "john dot doe (at) example dot com"),
    ("email", "und.34 at mail7.example.com"),
    ("email", "jane[at]example[dot]org"),
    ("email", "jane { AT } example { DOT } org"),
    ("email", "jоhn.dоe@example.com"),
    ("email", "jane＠example．com"),
    ("email", "ja​ne@exam​ple.com"),
    ("email", "jane&#64;example.com"),
    ("email", "jean arroba ejemplo punto es"),
    ("ip", "one nine two dot one six eight dot one dot one"),
    ("ip", "192[.]168[.]10[.]1"),
    ("ip", "192 dot 168 dot 1 dot 77"),
    ("ip", "١٢.7.8.9"),
    ("card", "four nine two nine three four eight three eight five one four six three zero six"),
    ("card", "4929 3483 8514 63O6"),
    ("card", "４９２９ 3483 8514 6306"),
    ("phone", "plus one zero one seven five five five seven seven one three"),
    ("phone", "plus 49 30 1234567"),
    ("phone", "+1 (O17) 555-77l3"),
    ("phone", "plus eins zwei drei fünf FÜNF sechs sieben acht neun"),
]


@pytest.mark.parametrize(("kind", "disguise"), DISGUISED)
def test_disguised_finds_map_back_to_the_source(kind, disguise):
    for before, after in (("", ""), ("Ünï 𝄞 here: ", " and so on."), ("(", ")")):
        text = before + disguise + after
        spans = [(k, text[a:b]) for k, a, b, base in personal_data.spans_of(text) if not base]
        assert spans == [(kind, disguise)]


@pytest.mark.parametrize(
    "text",
    [
        "look at example.com for more",
        "jean@exemple.fr point final",
        "meet at noon at john.doe@example.com",
        "they scored two one three and left",
        "a polka dot dress at the door",
        "dot dot dot at at at . @ (at) [dot]",
        "on 12.10.2024 at 10.30",
        "version 1.2.3 at most",
    ],
)
def test_prose_stays_clean(text):
    assert all(base for *_, base in personal_data.spans_of(text))


def test_base_finds_stay_beside_disguised_ones():
    text = "jоhn.doe@example.com"
    assert [(k, text[a:b], base) for k, a, b, base in personal_data.spans_of(text)] == [
        ("email", "jоhn.doe@example.com", False),
        ("email", "hn.doe@example.com", True),
    ]


@pytest.mark.parametrize("unit", [" ", "1", "a", "1 ", "[ ", "a@", "one ", " at", "O0", "​", "1.", "+1 "])
def test_very_long_texts(unit):
    text = unit * 200_000
    assert all(0 <= a < b <= len(text) for _, a, b, _ in personal_data.spans_of(text))


def test_troubled_rows(docs, no_docs):
    found = personal_data.find(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.spans)) for r in found) == sorted(
        (i is None, i or 0, len(personal_data.spans_of(text or ""))) for i, text, *_ in ROWS
    )
    assert personal_data.find(no_docs).count() == 0


def test_the_query_equals_the_contract(spark, tmp_path):
    texts = [
        "mail a.b@c.example.com or 10.0.0.1, card 4929348385146306, +1 (017) 555-7713",
        "one nine two dot one six eight dot one dot one, then 1.2.3.4 and x@y.zz",
        "",
        None,
    ]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op12_personal_data(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        kinds = list(PLAIN)
        base = sorted(plain_finds(text), key=lambda s: (s[1], kinds.index(s[0])))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == kind for k, *_ in base) for kind in kinds
        ]
        everything = personal_data.spans_of(text)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in everything)
        assert set(base) <= {s[:3] for s in everything}
