"""Removal of earlier passages against its definition."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from inkledger.llm import matching, queries

N = matching.WINDOW
LAST = (1 << 63) - 1


def plain(rows):
    """(doc_id, n_words, n_removed, kept_sha256) of each row, in order."""
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - N + 1):
            key = tuple(w[k : k + N])
            least[key] = min(least.get(key, i), i)
    out = []
    for (doc_id, _), (i, w) in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - N + 1) if least[tuple(w[k : k + N])] < i for j in range(k, k + N)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def order(r):
    return (r[0] is None, r[0] or 0, *r[1:4])


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS anchor", "2 AS doc").repartition(3)
    got = matching.without_passages(docs).collect()
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(plain(rows), key=order)
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_index_counts_and_windows(parts):
    symbols = np.array([0, *(x for p in parts for x in (*p, 0))])
    index = matching.FMIndex(symbols)
    low, high = index.first[symbols], index.first[symbols + 1]
    text = "".join(map(str, symbols.tolist()))
    for k in range(1, 6):
        at = np.arange(k, len(symbols))
        keep = np.array([(symbols[e - k : e + 1] > 0).all() for e in at], dtype=bool)
        if not keep.any():
            break
        at = at[keep]
        if k == 1:
            now_low, now_high, ends = low[at], high[at], at
        else:
            stay = np.isin(ends, at)
            now_low, now_high, ends = now_low[stay], now_high[stay], ends[stay]
        now_low, now_high = index.step(symbols[ends - k], now_low, now_high)
        for e, a, b in zip(ends, now_low, now_high, strict=True):
            word = text[e - k : e + 1]
            assert b - a == sum(text.startswith(word, j) for j in range(len(text)))


def test_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 777)
    low = rng.integers(0, 777, 500)
    high = np.minimum(low + rng.integers(0, 300, 500), 777)
    got = matching.Minima(values).of(low, high)
    assert got.tolist() == [min(values[a:b].tolist(), default=np.iinfo(np.int64).max) for a, b in zip(low, high, strict=True)]


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r)[:4] for r in queries.op12_matching(spark, SF).collect()]
    want = plain(rows)
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 1000


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice((12, 13, 14, 40, 90)))] for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
            words += rng.choice(passages) if rng.random() < 0.7 else ["same"] * rng.randrange(30)
        rows.append((rng.choice((k, k // 2, None, -k)), rng.choice((" ", "\n", "\x0b ")).join(words)))
    return rows + rows[:5] + [(k + 100, rows[k][1]) for k in range(8)]


def test_random_texts_repeated_rows_and_ids(spark):
    same(spark, cases(1))


def test_large_anchors_and_small_shards(spark, monkeypatch):
    for block in (60, 400):
        monkeypatch.setattr(matching, "BLOCK", block)
        same(spark, cases(2))


def test_frequent_anchors(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(30))
    rng = random.Random(4)
    rows = [(k, f"{rng.random()} {passage} {rng.random()} " * (1 + k % 2)) for k in range(120)]
    monkeypatch.setattr(matching, "SAMPLED", 2)
    same(spark, rows)


def test_edges(spark):
    w = " ".join(f"v{k}" for k in range(13))
    long_text = " ".join(str(k % 5000) for k in range(60_000))
    rows = [(1, None), (1, ""), (None, w), (None, w), (5, w), (5, w), (5, w + " x"), (4, "y " + w), (3, w.upper()), (2, w.rsplit(" ", 1)[0]), (9, long_text), (10, long_text), (-(2**63), "é " * 40), (7, "é " * 14), (8, "a b " * 20), (8, "a b " * 13)]
    same(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert matching.without_passages(docs.where("doc_id = 99")).count() == 0
