"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkledger.llm import fingerprints, html, jaccard, language, lines, mixing, packing, sstable, suffixes, topk
from inkledger.llm.queries import TOKENIZER

WORDS = [["the", "and", "with", "whether", "shall", "thing", "other"], ["der", "und", "nicht", "schöne", "über", "zwischen", "lange"]]


def prose(seed: int, n: int, lang: int = 0) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + str(r.choice(["", "", "ly", "ness", "keit"])) for _ in range(n))


LONG = prose(5, 40_000)
ROWS = [
    (1, prose(1, 90), "en", "a", 1), (2, None, "en", "a", None), (3, "", "de", None, 0), (4, prose(2, 80, 1), "de", "b", 2), (5, prose(2, 80, 1), None, "b", 2), (6, "one two", "en", "a", 7),
    (7, "12 34 !!", None, "b", 8), (None, prose(3, 60), "en", "a", 3), (8, LONG, "en", "c", len(LONG)), (9, LONG[: len(LONG) // 2] + " end", "en", "c", 4), (10, prose(1, 90) + " more", "en", "a", 1),
    (1, prose(1, 90), "en", "a", 1), (11, "same line\nother " + prose(7, 20), "en", "a", 5), (12, "é" * 300 + "\n\n\t x", "de", None, 6), (12, "é" * 300 + "\n\n\t x", "de", None, 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows


@pytest.fixture(scope="module")
def crowded(docs):
    """docs with columns of names that operators use inside."""
    for name in ("key", "row", "place", "tie", "ghost", "data", "host", "lines", "rate", "kept", "topic", "n_tokens", "n_lines", "salt", "rank", "prefix", "label", "d_source", "frequent", "hot", "_kept"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "fingerprints": fingerprints.fingerprinted,
    "mixing": lambda d: mixing.mixed(d).select("doc_id", "n_tokens", "kept"),
    "language": language.identified,
    "sstable": lambda d: sstable.read_back(d.sparkSession, sstable.written(d, TOKENIZER)),
    "suffixes": suffixes.without_repeats,
    "lines": lambda d: lines.without_boilerplate(d).select("doc_id", "text", "n_lines", "n_dropped"),
    "packing": lambda d: packing.packed(d, TOKENIZER),
    "jaccard": jaccard.linked,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(name, docs, crowded):
    plain = lambda d: sorted(map(str, OPERATORS[name](d).drop("sequence_id", "offset").collect()))
    assert plain(docs) == plain(crowded)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, none):
    assert OPERATORS[name](none).count() == 0


def test_fingerprints(docs):
    got = fingerprints.fingerprinted(docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        a, b = here[1] or "", after[1] or ""
        cut = len(a) // 3
        want.setdefault(here[0], set()).add(hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest())
    assert all(r.edited_sha256 in want[r.doc_id] for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].fingerprint == by_id[5].fingerprint != by_id[1].fingerprint
    assert by_id[2].near_edited == by_id[3].near_edited == 1.0


def test_language(docs):
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    assert {got[k].lang_pred for k in (2, 3, 7)} == {"und"}
    assert got[1].lang_pred == "en" and got[4].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_without_labels_nothing_is_predicted(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identified(bare).collect()} == {"und"}
    assert language.with_language(bare).count() == len(ROWS)


def test_sstable_keeps_order_and_repeats(docs, spark):
    shards = sstable.written(docs, TOKENIZER)
    got = sstable.read_back(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}


def test_repeats(docs):
    got = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert got[4].n_removed == got[4].n_bytes == got[5].n_removed
    assert got[2].n_removed == got[3].n_removed == got[6].n_removed == 0
    half = len(LONG) // 2
    assert got[9].n_removed >= half - 400 and got[8].n_removed >= half - 400


def test_packing(docs):
    got = packing.packed(docs, TOKENIZER).collect()
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert room.get(r.sequence_id, 0) == r.offset
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 4096
    assert sum(r.length for r in got if r.doc_id == 2) == 1


def test_jaccard(docs):
    got = {r.doc_id: r for r in jaccard.linked(docs).collect()}
    assert got[10].component_id == got[1].component_id == 1
    assert got[5].component_id == got[4].component_id == 4
    assert got[2].n_shingles == got[3].n_shingles == 0 and (got[2].component_id, got[3].component_id) == (2, 3)
    assert got[6].n_shingles == 1


def test_top_k(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.5], 0), (2, [1.0, 0.5], 0), (3, None, 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [], 0), (7, [1.0], 0), (None, [9.0, 9.0], 0), (100, [1e30, -1e30], 1), (1, [1.0, 0.5], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, k=5).collect())
    # floor(1024 * 1e30) * 1024 leaves a long: it comes first, as the largest one.
    assert got[:4] == [(0, 1, 100, 2**63 - 1), (0, 2, 1, 1048576), (0, 3, 1, 1048576), (0, 4, 2, 1048576)]
    assert topk.top_k(vectors.where("vec_id = 1")).count() == 0
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_top_k_ranks_large_components_exactly(spark):
    # 1024 * 100000 squared and beside 1024 * 90000; then scores beyond a long on both sides, told apart by their exact values.
    rows = [(0, [100000.0]), (1, [90000.0]), (2, [100000.0]), (100, [2.0**80]), (3, [2.0**70]), (4, [2.0**70 + 2.0**20]), (5, [-(2.0**70)]), (6, [-(2.0**71)])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(vectors, k=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in got[0]] == [100, 4, 3, 2, 1, 5, 6]
    assert got[0][3:5] == [(2, 10485760000000000), (1, 9437184000000000)]
    assert [v for v, _ in got[100]] == [4, 3, 0, 2, 1, 5, 6]
    assert {s for _, s in got[0][:3]} == {2**63 - 1} and {s for _, s in got[0][-2:]} == {-(2**63)}


def test_top_k_queries_of_one_id(spark):
    rows = [(0, [1.0]), (0, [-1.0]), (0, [1.0]), (1, [1.0]), (2, [2.0])]
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, -1048576), (1, 2, 2097152), (2, 1, 1048576), (2, 2, -2097152)]


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>text, and some more of it &amp; more.<p>next one"), (4, "u", "<div " + "a" * 100_000), (4, "u", "<article><p>" + "word, and more. " * 20_000 + "</p></article>")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(got) == 5 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == len("word, and more. " * 20_000) - 1
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(name, stage, spark, docs, none):
    got = stage(spark, docs, "")
    if name != "sequences":
        assert got.columns == docs.columns and got.schema == docs.schema
    assert 0 < got.count() <= len(ROWS) + 60
    assert stage(spark, none, "").count() == 0


def test_near_duplicates_keep_one_of_each(spark, docs):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard.one_of_each(docs).collect())
    ids = [i for missing, i in got if not missing]
    assert ids == [1, 2, 3, 4, 6, 7, 8, 9, 11, 12]
    assert sum(missing for missing, _ in got) == 1


def test_boilerplate_lines(spark):
    rows = [(i, f"menu of the site\n\nown text {i}", "en", "h" if i < 60 else None, 1) for i in range(70)]
    got = lines.without_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.text, r.n_lines, r.n_dropped) for r in got if r.doc_id == 3} == {("\nown text 3", 3, 1)}
    assert all(r.n_dropped == 1 for r in got)


def test_boilerplate_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, f"menu\nown {i}", "en", "h", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    small = sorted(map(str, lines.without_boilerplate(docs).collect()))
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert sorted(map(str, lines.without_boilerplate(docs).collect())) == small


def test_cleanup(spark, docs):
    from pathlib import Path

    from inkledger.llm.common import cleanup, shared_dir, stored

    stored(docs, "left").count()
    folder = Path(shared_dir(spark).removeprefix("file://"))
    assert any(folder.glob("left-*"))
    cleanup(spark)
    assert not any(folder.glob("left-*"))


def test_fingerprints_of_repeated_and_null_ids(spark):
    """One id, or none, holds most rows: each row still has its neighbour, whatever the ranges."""
    rows = [(7, f"text number {k} " * 3) for k in range(60)] + [(None, f"no id {k} " * 2) for k in range(60)] + [(k, f"own {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_ranges = [sorted(map(str, fingerprints.fingerprinted(docs, ranges=n).collect())) for n in (1, 3, 16)]
    assert len(by_ranges[0]) == len(rows) and by_ranges[0] == by_ranges[1] == by_ranges[2]


def test_fingerprint_query_against_brute_force(docs):
    """n_chars, the edited text's hash and both likenesses of every row, from windows compared as text."""
    rows = sorted(((r[0], r[1] or "") for r in ROWS if r[0] is not None and r[0] != 1 and r[0] != 12), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.fingerprinted(docs.where("doc_id IS NOT NULL AND doc_id NOT IN (1, 12)")).collect()}

    def windows(text):
        width = min(fingerprints.WINDOW, len(text))
        return {text[k : k + width] for k in range(len(text) - width + 1)} if text else set()

    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for likeness, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = windows(text), windows(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            # Exact for small sets; of larger ones, the share among the least hashes.
            assert abs(likeness - exact) < (1e-9 if len(a | b) <= fingerprints.SKETCH else 0.17)
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)


def test_fingerprint_ranges_take_repeated_rows_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "same text")] * 3000 + [(k, f"text {k}") for k in range(2, 302)], "doc_id long, text string")
    collected = []
    real = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: collected.append(out := real(self)) or out)
    frame = fingerprints.fingerprinted(docs, ranges=4)
    assert max(map(len, collected)) <= 301
    got = real(frame)
    assert len(got) == 3300 and sum(r.near_next == 1.0 for r in got if r.doc_id == 1) == 2999
