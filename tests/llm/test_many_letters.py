"""Languages are told apart by all their letters, however many scripts there are."""

import random

import numpy as np

from inkledger.llm import language


def words(seed: int, first: int, n: int, letters: int) -> str:
    """Text in letters of their own, from a code point on."""
    r = random.Random(seed)
    some = ["".join(chr(first + r.randrange(letters)) for _ in range(r.randrange(2, 6))) for _ in range(40)]
    return " ".join(r.choice(some) for _ in range(n))


def test_languages_of_rare_scripts_are_told_apart():
    frequent = {f"latin{k}": words(k, ord("a"), 3000, 26) for k in range(2)} | {"russian": words(2, ord("а"), 3000, 32)}
    # Each has few texts, so that its letters are none of the most frequent 61; two share their letters.
    rare = {"greek1": words(3, ord("α"), 150, 17), "greek2": words(4, ord("α"), 150, 17), "georgian": words(5, ord("ა"), 150, 33), "chinese1": words(6, 0x4E00, 300, 900), "chinese2": words(7, 0x4E00, 300, 900)}
    sample = frequent | rare
    model = language.Model(sample)
    cut = {name: text[len(text) // 3 : len(text) // 3 + 60] for name, text in sample.items()}
    assert [r[0] for r in model.predict(list(cut.values()))] == list(cut)


def test_phrases_of_a_large_alphabet_are_longest_matches():
    r = random.Random(1)
    letters = [chr(0x4E00 + k) for k in range(300)]
    sample = "".join(r.choice(letters) for _ in range(3000))
    model = language.Model({"zh": sample, "en": "abc"})
    text = "".join(sample[a : a + 5] for a in (r.randrange(2900) for _ in range(40))) + "aꙮ"
    count, at = 0, 0
    while at < len(text):
        n = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in sample), 0)
        count, at = count + 1, at + max(n, 1)
    assert int(model.automata[0].phrases(model.symbols([text])[0][:, None], np.ones(len(text), dtype=int))[0]) == count
