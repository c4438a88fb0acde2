"""Line breaks against a plain reading of the rules, and the roll-up against its parts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from inkledger.functions import charsets as cs
from inkledger.operators import fidelity, pairing, reflow
from inkledger.sources.tables import marked as marked_view

LETTERS = "ab -\n　中​⁠\xad‌\t‎\r– "


def kind(c: str) -> str:
    if c in "\n\x0b\x0c\x85  ":
        return "hard"
    if c == "\r":
        return "none"
    if c in " \t 　":
        return "space"
    named = {"​": "zero", "⁠": "glue", "﻿": "glue", "\xad": "hyphen", "-": "hyphen", "‐": "hyphen", "–": "hyphen"}
    if c in named:
        return named[c]
    return "none" if c in cs.CONTROL else "wide" if 0x3041 <= ord(c) <= 0x9FFF else "letter"


def may(a: str, b: str) -> bool:
    if b == "hard" or a == "hard":
        return b != "hard"
    if "glue" in (a, b):
        return False
    if a == "zero" or b == "zero":
        return a == "zero"
    if a == "space" or b == "space":
        return a == "space"
    return a == "hyphen" or "wide" in (a, b)


def plain_breaks(text: str) -> list[int]:
    seen = [k for k, c in enumerate(text) if kind(c) != "none"]
    return [b for a, b in zip(seen, seen[1:], strict=False) if may(kind(text[a]), kind(text[b]))]


def plain_wraps(text: str, width: int) -> list[int]:
    size = lambda c: 0 if kind(c) == "hard" or c == "\r" or c in cs.CONTROL else 2 if kind(c) == "wide" or c == "\u3000" else 1
    cuts, out, line, fresh = [0, *plain_breaks(text), len(text)], [], 0, True
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = text[a:b]
        if not part:
            continue
        bare = part
        while bare and kind(bare[-1]) in ("space", "hard", "none"):
            bare = bare[:-1]
        if not fresh and line + sum(map(size, bare)) > width:
            out.append(a)
            line = 0
        elif fresh:
            line = 0
        line += sum(map(size, part))
        ends = [c for c in part if kind(c) != "none"]
        fresh = bool(ends) and kind(ends[-1]) == "hard"
        if fresh:
            line = 0
    return out


@given(st.text(alphabet=LETTERS, max_size=60), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_breaks_and_wraps(text, width):
    codes = reflow.codes_of(text)
    assert reflow.opportunities(codes).tolist() == plain_breaks(text)
    assert reflow.wraps(codes, reflow.opportunities(codes), width) == plain_wraps(text, width)


def laid_out(cover, marked, width):
    one, two = reflow.codes_of(cover), reflow.codes_of(marked)
    return reflow.compared(one, two, pairing.paired_codes(one, two).in_cover, width)


def test_marks_that_add_or_move_breaks():
    compared = lambda cover, marked, width=80: laid_out(cover, marked, width)
    assert compared("one two", "one two") == (0, 0, 0, 0)
    # A zero-width space in a word adds a place to break, a joiner behind a space takes one away.
    assert compared("onetwo three", "one\u200btwo three")[2:] == (1, 0)
    assert compared("one two", "one \u2060two")[2:] == (0, 1)
    # Spaces of no width after each word move nothing at this width.
    cover = "word " * 40
    assert compared(cover, cover.replace(" ", " \u200b"), 80)[1] == 0
    assert compared(cover, cover.replace(" ", " \u2060"), 80)[1] > 0


@pytest.fixture(scope="module")
def pairs(spark):
    return marked_view(spark.read.parquet(f"{SF}/documents.parquet")).cache()


def test_roll_up_against_its_parts(spark, pairs):
    whole = {r.doc_id: r for r in fidelity.assessed(pairs).collect()}
    parts = {name: {r.doc_id: r for r in rows.collect()} for name, rows in {
        "aligned": fidelity.aligned(pairs), "words": fidelity.word_selection(pairs), "bidi": fidelity.bidi_balance(pairs), "spread": fidelity.distribution(fidelity.marks(pairs)),
        "density": fidelity.density(pairs).where("mission = 'conceal'"), "lines": fidelity.reflowed(pairs),
    }.items()}
    order = {"clean": 0, "degraded": 1, "conspicuous": 2}
    seen = set()
    for i, r in whole.items():
        a = parts["aligned"][i]
        seen.add(r.reader_verdict)
        if a.failure:
            assert (r.reader_verdict, r.reader_risk, r.analyst_exposure, len(r.not_run)) == ("indeterminate", 0.0, "indeterminate", 7)
            continue
        m, lines, words = a.insertions + a.substitutions, parts["lines"][i], parts["words"][i]
        missing = (["distribution"] if m < 5 else []) + (["density"] if not a.n or m > a.n else [])
        assert r.not_run == missing
        reflowed = "conspicuous" if lines.moved else "degraded" if lines.gained + lines.lost else "clean"
        verdicts = {"reflow": reflowed, "bidi_balance": parts["bidi"][i].verdict, "word_selection": words.verdict, "paste_safety": "conspicuous" if lines.marks_in_code else "clean"}
        worst = max(verdicts.values(), key=order.get)
        assert r.reader_verdict == ("indeterminate" if missing else worst)
        risks = {c: 0.5 + 0.5 * words.broken / words.words if c == "word_selection" and v == "conspicuous" else fidelity.RTL_RISK if c == "bidi_balance" and parts["bidi"][i].rtl_beside_neutrals else fidelity.RISKS[c].get(v, 0.0) for c, v in verdicts.items()}
        assert abs(r.reader_risk - max(risks.values())) < 1e-12
        assert (r.worst_check is None) == (r.reader_risk == 0) and (r.worst_check is None or risks[r.worst_check] == max(risks.values()))
        uneven = parts["spread"][i].ks if m >= 5 and not parts["spread"][i].uniform else 0.0
        assert r.analyst_risk == (1.0 if m else 0.0) >= uneven
    assert {"clean", "conspicuous", "indeterminate"} & seen


def test_rows_of_one_id_stay_apart(spark, pairs):
    twice = pairs.unionByName(pairs).where("doc_id < 20")
    assert fidelity.assessed(twice).count() == twice.count()
    assert fidelity.baseline(twice).where(F.col("analyst_exposure") == "exposed").count() > 0
