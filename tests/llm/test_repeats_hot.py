"""op7 where anchors, stretches and texts are hot, and where hashes of texts meet."""

import random

import pytest
from pyspark.sql import functions as F

from inkledger.llm import common, suffixes

DOCS = "doc_id long, text string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    passage = prose(0, 60)
    rows = [(k, prose(k, 30) + passage + prose(-k, 30)) for k in range(1, 60)]
    rows += [(100 + k, prose(999, 80)) for k in range(60)] + [(200 + k, "") for k in range(40)] + [(300 + k, prose(k + 400, 70)) for k in range(20)] + [(None, passage)]
    return spark.createDataFrame(rows, DOCS)


def removed(docs):
    return sorted(map(str, suffixes.without_repeats(docs).collect()))


def brute(rows):
    """Bytes removed of each text."""
    places = {}
    data = [(r.doc_id, (r.text or "").encode()) for r in rows]
    for k, (_, b) in enumerate(data):
        for i in range(len(b) - 199):
            places.setdefault(b[i : i + 200], []).append((k, i))
    gone = [set() for _ in data]
    for where in places.values():
        if len(where) > 1:
            for k, i in where:
                gone[k].update(range(i, i + 200))
    return sorted((str(i), len(b), len(g)) for (i, b), g in zip(data, gone, strict=True))


def test_hot_keys_give_the_same(docs, monkeypatch):
    want = brute(docs.collect())
    got = []
    for most, block in ((2000, 1 << 20), (2, 1 << 20), (5, 3000)):
        monkeypatch.setattr(common, "HOT_KEYS", most)
        monkeypatch.setattr(suffixes, "BLOCK", block)
        got.append(removed(docs))
    assert got[0] == got[1] == got[2]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.without_repeats(docs).collect()) == want


def test_texts_whose_hashes_meet(docs, monkeypatch):
    want = removed(docs)
    plain = F.xxhash64

    def meeting(*columns):
        got = plain(*columns)
        return got % 5 if len(columns) == 2 and columns[1] == "data" and columns[0]._jc.toString() == "0" else got

    monkeypatch.setattr(suffixes.F, "xxhash64", meeting)
    assert removed(docs) == want
