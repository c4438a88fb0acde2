"""Periodic runs against their definition."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from inkledger.llm import periods, queries


def smallest_period(word):
    return next(p for p in range(1, len(word) + 1) if all(word[k] == word[k - p] for k in range(p, len(word))))


def plain_runs(word):
    """Every stretch of period q, extended as far as it goes, if q is its smallest period."""
    n, found = len(word), []
    for q in range(1, n // periods.TIMES + 1):
        k = 0
        while k + q < n:
            if word[k] != word[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and word[k] == word[k + q]:
                k += 1
            length = k + q - start
            if length >= max(periods.LEAST, periods.TIMES * q) and smallest_period(word[start : start + 2 * q]) == q:
                found.append((start, length, q))
    return sorted(found)


def plain_report(words):
    found = plain_runs(words)
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 40)), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_runs_of_small_alphabets(parts):
    word = [x for unit, times in parts for x in unit * times][:400]
    assert periods.runs(np.array(word)) == plain_runs(word)


def test_runs_in_runs_and_long_ones():
    rng = random.Random(5)
    inner = [1, 2] * 15 + [3]
    cases = [inner * 4, [7] * 5000, list(range(40)) * 3, list(range(40)) * 2 + list(range(39)), [rng.randrange(2) for _ in range(3000)]]
    # A stretch that comes again far away, with a run across its end; a run that ends in the middle of a period.
    cases += [list(range(30)) + [5, 6, 7] * 9 + [5] + list(range(100, 200)) + list(range(30)) + [5, 6, 7] * 9 + [5, 6]]
    for word in cases:
        assert periods.runs(np.array(word)) == plain_runs(word)


def test_long_periodic_text_is_linear_in_memory_and_near_linear_in_time():
    rng = random.Random(3)
    unit = [rng.randrange(10**6) for _ in range(9000)]
    assert periods.runs(np.array(unit * 12)) == [(0, 108000, 9000)]


def test_ordered_sets():
    rng, plain = random.Random(1), {4000}
    ends = periods.Ends(4000)
    for _ in range(3000):
        x = rng.randrange(100_000)
        if x in plain:
            continue
        assert ends.before(x) == max((y for y in plain if y < x), default=-1)
        assert ends.after(x) == min((y for y in plain if y > x), default=-1)
        ends.add(x)
        plain.add(x)
    assert list(ends) == sorted(plain) and ends.size == len(plain)


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_periods(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        words = periods.looped(r.doc_id, (rows[r.doc_id] or "").encode().split())
        if len(words) < 6000:
            assert tuple(r)[1:8] == plain_report(words)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_edit_by_the_rule():
    import zlib

    doc_id = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [b"%d" % k for k in range(50)]
    g = zlib.crc32(str(doc_id).encode()) // 10
    a, n = g % 50, 50
    p = 1 + (n - a) // (3 + g % 8)
    assert periods.looped(doc_id, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    assert periods.looped(None, words) == words and periods.looped(doc_id, []) == []


@pytest.mark.parametrize("edited", [False, True])
def test_edges(spark, edited):
    long_text = "a b " * 60_000
    rows = [(1, None), (1, ""), (None, "x " * 30), (2, "x " * 23), (2, "x " * 24), (2, "x " * 24), (-5, "\x0b\x0c \t\n"), (7, long_text), (8, "é\u00a0é " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "text AS `start`")
    got = periods.periodic(docs, edited=edited).collect()
    assert len(got) == len(rows)
    if not edited:
        found = [(r.doc_id, r.n_runs, r.start, r.length, r.period) for r in got]
        expected = [(i, 0, None, None, None) for i in (1, 1, 2, -5)] + [(2, 1, 0, 24, 1)] * 2 + [(None, 1, 0, 30, 1), (7, 1, 0, 120_000, 2), (8, 1, 0, 24, 1)]
        assert sorted(found, key=str) == sorted(expected, key=str)
        by = {(r.doc_id, r.length): r for r in got}
        assert by[7, 120_000].exponent_milli == 60_000_000 and by[7, 120_000].collapsed_sha256 == hashlib.sha256(b"a b").hexdigest()
        assert by[None, 30].collapsed_sha256 == hashlib.sha256(b"x").hexdigest() and by[8, 24].period == 1
    assert periods.periodic(docs.where("doc_id > 99"), edited=edited).count() == 0
