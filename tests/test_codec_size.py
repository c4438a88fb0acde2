"""Placement and reading of bits do the same work a character, whatever the text."""

from __future__ import annotations

import pytest

from inkledger.operators import codec


def test_a_scan_reads_no_more_than_a_frame_behind_each_magic(monkeypatch):
    sizes = []
    read = codec.unframe
    monkeypatch.setattr(codec, "unframe", lambda bits: sizes.append(len(bits)) or read(bits))
    assert codec.scan(f"{codec.MAGIC:016b}" * 20000) is None
    assert max(sizes) <= 8 * 24 + 0xFFFF


def test_the_largest_frame_is_found():
    bits = codec.to_bits(codec.frame(bytes(8191), salt=bytes(range(16))))
    assert codec.scan("0" * 5 + bits + "1" * 9) == (0, bytes(range(16)), bytes(8191))


@pytest.mark.parametrize("text", ["", "a", "ab c", "`a` b", "x $y$ z", "```\na\n``` b", "ö½² _a", "中文 ab"])
def test_slots_are_the_gaps_outside_words_and_regions(text):
    word = [c.isalnum() or c == "_" for c in text]
    shut = {k for low, high, _ in codec.protected(text) for k in range(low, high + 1)}
    assert codec.slots(text) == [k for k in range(len(text) + 1) if k not in shut and not (0 < k < len(text) and word[k - 1] and word[k])]


def test_runs_of_ticks_are_met_once_each():
    text = "a `b `` c ``` d\n" * 3
    assert codec.protected(text + "`x`")[-1] == (len(text), len(text) + 3, "code")
