"""Wrapping takes steps for lines, not for words, and breaks where a first fit does."""

from __future__ import annotations

from inkledger.operators import reflow


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


def test_steps_of_wrapping_are_those_of_lines_not_of_words():
    codes = reflow.codes_of("a " * 4000)
    breaks = reflow.opportunities(codes)
    assert len(reflow.wraps(codes, breaks)) == 99
    assert calls_of(lambda: reflow.wraps(codes, breaks)) < 500


def test_wraps_at_hard_breaks_and_wide_words():
    for text, width, expected in (("aa bb\ncc dd", 5, []), ("aa bb cc", 5, [6]), ("aaaaaaa b\nc", 5, [8]), ("a\n\nbb cc dd\n", 5, [9]), ("a    b", 3, [4]), ("", 5, [])):
        codes = reflow.codes_of(text)
        assert reflow.wraps(codes, reflow.opportunities(codes), width) == expected
