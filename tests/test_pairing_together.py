"""Controls of a cover are taken gap by gap, at once: work of a text is a fixed few steps, and the pairing is that of a reading from the start."""

from __future__ import annotations

import random

import pytest

from inkledger.operators import pairing, reflow

A, B = "​", "⁠"


def by_reading(cover: str, marked: str) -> tuple:
    """failure, failure_at, places of the insertions: one character of the copy after the other."""
    controls = {c for c in cover + marked if c in pairing.cs.CONTROL}
    now, put = 0, []
    for k, c in enumerate(marked):
        if c in controls:
            if now < len(cover) and cover[now] == c:
                now += 1
            else:
                put.append(now)
        elif now < len(cover) and cover[now] in controls:
            return pairing.CONTROL_MISSING, now, []
        elif now == len(cover):
            return pairing.CONTENT_ADDED, k, []
        else:
            now += 1
    return (pairing.CONTENT_MISSING, now, []) if now < len(cover) else (None, -1, put)


@pytest.mark.parametrize("seed", range(4))
def test_pairing_is_that_of_a_reading(seed):
    r = random.Random(seed)
    for _ in range(2000):
        cover = "".join(r.choice((A, B, "x", A * r.randrange(7, 12))) for _ in range(r.randrange(7)))
        marked = "".join((c if r.random() < 0.97 else "") + r.choice(("", "", A, B)) for c in cover)
        found = pairing.paired_codes(reflow.codes_of(cover), reflow.codes_of(marked))
        assert (found.failure, found.failure_at, found.place[found.put_in].tolist()) == by_reading(cover, marked), (cover, marked)


def calls_of(work) -> int:
    import sys

    n = 0

    def seen(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def test_steps_of_a_pairing_dont_grow_with_the_marks():
    def pair(n: int) -> int:
        cover = f"word, {A}" * n
        one, two = reflow.codes_of(cover), reflow.codes_of(cover.replace(", ", f", {A}{B}"))
        pairing.paired_codes(one, two)
        return calls_of(lambda: pairing.paired_codes(one, two))

    assert pair(400) < 2 * pair(4)
