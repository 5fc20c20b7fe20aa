"""Disguised words with decoration, spaced over whole sentences, and drawn out at length."""

import pytest
from test_toxicity import INSULTS, planted, restore  # noqa: F401


@pytest.mark.parametrize(
    "word, meant",
    [("1d10t!!!", "idiot"), ("m0r0n!!!", "moron"), ("5tup!d!!!", "stupid"), ("!!!1d10t", "idiot"), ("$$$1d10t", "idiot"),
     ("$$$cum", "scum"), ("m0r0n$$$", "moron"), ("1d10t!!!\",", "idiot"), ("1d10t+++m0r0n", "idiot"), ("st!!!pid1d10t", "idiot")],
)
def test_decorated_words_are_restored(restore, word, meant):  # noqa: F811
    assert meant in restore(f"the {word} of")


@pytest.mark.parametrize("text", ["the$$$ of", "$$$the of", "the!!! @@@ +++", "there!!!the", "|||the||| of"])
def test_decoration_of_plain_words_stays(restore, text):  # noqa: F811
    assert restore(text) == text


@pytest.mark.parametrize(
    "text, insults",
    [
        (" ".join("youareaworthlessidiotandastupidmoronandascumloser"), ["worthless", "idiot", "stupid", "moron", "loser"]),
        ("s t u p i d - i d i o t", ["stupid", "idiot"]),
        ("s t u p i d & i d i o t 2 m 0 r 0 n.", ["stupid", "idiot", "moron"]),
        ("s + u p i d | d i o t", ["stupid"]),
        ("s+upid s.+.u.p.i.d", ["stupid"]),
        ("s t u p i d!!! i d i o t??????!!!!!!", ["stupid", "idiot"]),
        ("i" + "d" * 3 + "i" + "o" * 60 + "t", ["idiot"]),
        ("l" + "o" * 5000 + "ser", ["loser"]),
    ],
)
def test_long_and_parted_runs_are_restored(restore, text, insults):  # noqa: F811
    assert all(insult in restore(f"the {text} of").replace(" ", "") for insult in insults)


def test_runs_keep_what_stands_between_them(restore):  # noqa: F811
    assert restore("s t u p i d - i d i o t & on") == "stupid - idiot & on"


def test_long_spans_take_time_in_proportion(restore):  # noqa: F811
    assert len(restore("x1" * 20_000)) == 40_000
    assert restore(" ".join("stupid" * 2000)).replace(" ", "").count("stupid") == 2000
