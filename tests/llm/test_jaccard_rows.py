"""Rows of repeated and null ids, hot sets, and sets whose hashes meet."""

import numpy as np
import pyarrow as pa
import pytest

from inkledger.llm import common, jaccard

A, B = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize(
    "rows,left",
    [
        ([(1, A), (None, A), (None, B)], {(1, A), (None, B)}),
        ([(1, A), (2, B), (2, A)], {(1, A), (2, B)}),
        ([(1, A), (1, A), (1, A), (None, A)], {(1, A)}),
        ([(None, A), (None, A), (None, B)], {(None, A), (None, B)}),
        ([(3, A), (3, B), (4, A), (4, B)], {(3, A), (3, B)}),
    ],
)
def test_one_row_of_each_group_stays(spark, rows, left):
    rows = [*rows, (7, ""), (7, ""), (8, None), (None, " \n ")]
    got = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*left, (7, ""), (7, ""), (8, None), (None, " \n ")]))


def test_extra_columns_of_any_name_stay(spark):
    rows = [(k, A if k < 20 else f"{k} {B} {k}", k, [k], "mine") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, label array<int>, text_1 string")
    got = sorted(tuple(r) for r in jaccard.one_of_each(docs).collect())
    assert got == sorted(rows[:1] + rows[20:])


def test_a_hot_set_gives_the_same(spark, monkeypatch):
    rows = [(k, A if k % 3 else f"{B} {k % 40}") for k in range(300)] + [(1000 + k, "") for k in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    both = []
    for most in (2000, 3, 1):
        monkeypatch.setattr(common, "HOT_KEYS", most)
        both.append(sorted(map(str, jaccard.linked(docs).collect())))
    assert both[0] == both[1] == both[2] and len(both[0]) == len(rows)


def test_sets_whose_hashes_meet_are_described_again(spark, monkeypatch):
    plain = jaccard.set_keys

    def meeting(values, bounds, seed=0):
        keys, checks = plain(values, bounds, seed)
        return (np.where(keys == 0, 0, keys % 3 + 5) if seed == 0 else keys), checks

    rows = [(k, f"{A} {k % 7}") for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(str, jaccard.linked(docs).collect()))
    monkeypatch.setattr(jaccard, "set_keys", meeting)
    assert sorted(map(str, jaccard.linked(docs).collect())) == want


@pytest.mark.parametrize("bucket", [1_000_000, 40, 8])
def test_buckets_of_any_number(spark, bucket, monkeypatch):
    rows = [(k, " ".join(str(x) for x in range(k % 20 * 50, k % 20 * 50 + 40)) + f" {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    got = jaccard.linked(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 20 for k in range(60)}


def test_only_what_the_result_reads_is_left(spark):
    from pathlib import Path

    rows = [(k, f"{A} {k % 7}") for k in range(40)]
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    got = jaccard.linked(spark.createDataFrame(rows, DOCS))
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before) == ["named", "sets"]
    assert got.count() == len(rows)


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_words_that_a_polynomial_hash_takes_for_one_another(spark, letters):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(letters))
    two = one.translate(str.maketrans("ab", "ba"))
    values, bounds = jaccard.shingle_sets(pa.array([one, two, one.upper()]))
    assert values[0] != values[1] and values[0] == values[2] and bounds.tolist() == [0, 1, 2, 3]
    docs = spark.createDataFrame([(1, one), (2, two), (3, "another text"), (4, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.linked(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r.doc_id for r in jaccard.one_of_each(docs).collect()} == {1, 2, 3}
