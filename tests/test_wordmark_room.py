"""A word mark takes the room that a text has, so that another key finds it by chance the more seldom."""

from __future__ import annotations

from inkledger.operators import wordmark as wm

KEY = b"k" * 32


def test_a_text_with_more_synonyms_isnt_found_by_another_key():
    # Under a mark of 16 bits both keys found the first of these texts.
    first = " ".join(a for a, _ in wm.PAIRS[:16])
    near = [f"x{k} {first}" for k in (136396, 1, 2)]
    for text in near:
        marked = wm.signed(text + " big fast help near often use keep get", KEY)
        assert wm.has_signature(marked, KEY) and not wm.has_signature(marked, b"other" + KEY)


def test_every_synonym_up_to_the_last_counts():
    text = " ".join(wm.WORDS)
    marked = wm.signed(text, KEY)
    assert wm.canonical(marked) == wm.canonical(text)
    for at in range(40):
        assert not wm.has_signature(wm._with_variants(marked, lambda k, v, at=at: 1 - v if k == at else v), KEY)


def test_bounds_of_the_number_of_synonyms():
    assert wm.signed(" ".join(["big"] * 15), KEY) is None
    for n in (16, 17, 64, 65, 200):
        marked = wm.signed(" ".join(["big"] * n), KEY)
        assert wm.has_signature(marked, KEY) and not wm.has_signature(marked, b"other" + KEY)
