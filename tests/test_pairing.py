"""Pairing of covers and copies against a reading from the start, character by character."""

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from inkledger.functions import charsets as cs
from inkledger.operators import codec, fidelity, pairing, reflow

LETTERS = "ab_1 ,`\nа​‌‏‎⁠‪‬⁧⁩﻿"


def read(cover: str, marked: str):
    """(failure, place) or the marks as (place in the copy, in the cover, put in) and the cover's place of each character."""
    marks, places, i = [], [], 0
    for j, m in enumerate(marked):
        if i < len(cover) and cover[i] == m:
            places.append(i)
            i += 1
        elif m in cs.CONTROL:
            marks.append((j, i, True))
            places.append(i)
        elif i < len(cover):
            if cover[i] in cs.CONTROL:
                return (pairing.CONTROL_MISSING, i), None
            marks.append((j, i, False))
            places.append(i)
            i += 1
        else:
            return (pairing.CONTENT_ADDED, j), None
    return ((pairing.CONTENT_MISSING, i), None) if i < len(cover) else (marks, places)


def scopes(text: str):
    stack, lone = [], 0
    for c in text:
        if c in "‪‫‭‮":
            stack.append("‬")
        elif c in "⁦⁧⁨":
            stack.append("⁩")
        elif c in "‬⁩":
            if c in stack:
                while stack.pop() != c:
                    pass
            else:
                lone += 1
    return len(stack), lone


@st.composite
def pairs(draw):
    cover = draw(st.text(alphabet=LETTERS, max_size=30))
    marked = []
    for c in cover:
        marked += draw(st.text(alphabet="​‌‏⁠‬⁧", max_size=2))
        kind = draw(st.integers(0, 24))
        marked.append({0: "", 1: "а", 2: "b"}.get(kind, c))
    return cover, "".join(marked) + draw(st.sampled_from(["", "", "​", "⁩", "x"]))


@given(pairs())
@settings(max_examples=1500, deadline=None)
def test_pairing_and_what_rests_on_it(pair):
    cover, marked = pair
    got = pairing.paired_codes(reflow.codes_of(cover), reflow.codes_of(marked))
    want, places = read(cover, marked)
    row = pairing._row(cover, marked, ("places", "checks", "layout"))
    assert row["n"] == len(cover)
    if places is None:
        assert (got.failure, got.failure_at) == want == (row["failure"], row["failure_at"])
        return
    assert got.failure is None
    assert list(zip(got.at.tolist(), got.place.tolist(), got.put_in.tolist(), strict=True)) == want
    assert got.in_cover.tolist() == [*places, len(cover)]
    assert row["places"] == [i for _, i, _ in want] and row["characters"] == [marked[j] for j, _, _ in want]
    # Words by their letters.
    spans = [m.span() for m in regex.finditer(r"[\p{Alphabetic}\p{N}_]+", cover)]
    letter = lambda c: regex.fullmatch(r"[\p{Alphabetic}\p{N}_]", c) is not None
    broken = {s for s in spans for _, i, put in want if put and s[0] < i < s[1]}
    mixed = {s for s in spans for j, i, put in want if not put and s[0] <= i < s[1] and letter(marked[j])}
    assert (row["words"], row["broken"], row["mixed"]) == (len(spans), len(broken), len(mixed))
    # Marks from right to left beside white space, punctuation or symbols.
    neutral = lambda c: c not in cs.CONTROL and (c.isspace() or not regex.fullmatch(r"[\p{Alphabetic}\p{N}]", c))
    beside = [j for j, _, put in want if put and marked[j] in "‏؜" and any(0 <= k < len(marked) and neutral(marked[k]) for k in (j - 1, j + 1))]
    assert row["rtl_beside_neutrals"] == len(beside)
    assert row["direction_marks"] == sum(put and marked[j] in "‎‏؜" for j, _, put in want)
    (a, b), (c, d) = scopes(cover), scopes(marked)
    assert (row["unclosed"], row["orphans"]) == (max(0, c - a), max(0, d - b))
    code = [(low, high) for low, high, kind in codec.protected(cover) if kind != "maths"]
    assert row["marks_in_code"] == sum(low <= i < high for _, i, _ in want for low, high in code)


def test_named_refusals_and_their_places(spark):
    rows = [(1, "a​b", "ab"), (2, "ab", "abc"), (3, "abc", "ab"), (4, "ab⁠", "ab"), (5, None, "​"), (6, "", None), (7, "​‌a", "‌​‌a"), (8, "кот a", "кот а")]
    pairs_ = spark.createDataFrame(rows, "doc_id long, cover string, marked string").selectExpr("*", "'x' AS k")
    got = {r.doc_id: (r.n, r.failure, r.failure_at, r.insertions, r.substitutions, r.k) for r in fidelity.aligned(pairs_).collect()}
    assert got[1] == (3, pairing.CONTROL_MISSING, 1, None, None, "x")
    assert got[2] == (2, pairing.CONTENT_ADDED, 2, None, None, "x")
    assert got[3] == (3, pairing.CONTENT_MISSING, 2, None, None, "x")
    assert got[4] == (3, pairing.CONTENT_MISSING, 2, None, None, "x")
    assert got[5] == (0, None, None, 1, 0, "x") and got[6] == (0, None, None, 0, 0, "x")
    assert got[7] == (3, None, None, 1, 0, "x") and got[8] == (5, None, None, 0, 1, "x")


def test_right_to_left_marks_in_the_roll_up(spark):
    rows = [(1, "one, two and three", "one, ‏two and three"), (2, "one, two and three", "one, two and three‬"), (3, "one, two and three", "on‏e, two and three")]
    docs = spark.createDataFrame(rows, "doc_id long, cover string, marked string")
    got = {r.doc_id: r for r in fidelity.bidi_balance(docs).collect()}
    assert [(got[k].rtl_beside_neutrals, got[k].added_orphans, got[k].verdict) for k in (1, 2, 3)] == [(1, 0, "degraded"), (0, 1, "degraded"), (0, 0, "clean")]
    whole = {r.doc_id: (r.reader_risk, r.worst_check) for r in fidelity.assessed(docs).collect()}
    assert whole[1] == (0.45, "bidi_balance") and whole[2] == (0.35, "bidi_balance")


def test_audit_order_and_limit(spark):
    docs = spark.createDataFrame([(1, "abcdef", "a​b​c‌d⁠e⁠f")], "doc_id long, cover string, marked string")
    rows = [(r.codepoint, r.n, r.first_at, r["rank"]) for r in fidelity.audit(fidelity.marks(docs)).collect()]
    assert rows == [("U+200B", 2, 1, 1), ("U+2060", 2, 4, 2), ("U+200C", 1, 3, 3)]
    assert fidelity.audit(fidelity.marks(docs), 2).count() == 2
