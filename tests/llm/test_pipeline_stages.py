"""Each stage of the pipeline on rows whose fate is known, and beside columns of any name."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkledger.llm import packing
from inkledger.llm.queries import TOKENIZER

WORDS = {"en": "the and with whether shall thing other house water light people under after again".split(), "de": "der und nicht schöne über zwischen lange haus wasser licht leute unter nach wieder".split()}
STAGES = dict(corpus_pipeline.STAGES)
CLASHING = ("topic", "rate", "kept", "n_tokens", "sample_weight", "n_lines", "n_dropped", "page", "host", "lines", "doc", "key", "label", "row", "own", "rest", "text_1", "size", "phrases")


def prose(seed: int, lang: str, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(("", "", "s", "er", "en")) for _ in range(n))


def rows():
    out = [(k, prose(k, "en" if k % 2 else "de"), "en" if k % 2 else "de", f"s{k % 3}") for k in range(60)]
    out += [(100 + k, f"{prose(500, 'en')} {k}", "en", "s0") for k in range(8)]
    out += [(200 + k, f"Menu of the site\n{prose(700 + k, 'en')}", "en", "s9") for k in range(20)]
    out += [(300, "12 34 !!", None, "s0"), (301, None, "en", "s0"), (302, "", "de", None)]
    return [(i, t, lang, s, -1 if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()


@pytest.fixture(scope="module")
def crowded(docs):
    return docs.withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.mark.parametrize("name", [n for n in STAGES if n != "sequences"])
def test_columns_of_any_name_stay(name, spark, docs, crowded):
    plain, got = STAGES[name](spark, docs, ""), STAGES[name](spark, crowded, "")
    assert got.dtypes == crowded.dtypes
    found = got.collect()
    assert all(r[c] == "mine" for r in found for c in CLASHING)
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, plain.collect()))


def test_language_id(spark, docs):
    got = {r.doc_id: r.lang for r in STAGES["language_id"](spark, docs, "").collect()}
    assert set(got) == {r[0] for r in rows() if r[0] < 300}
    assert sum(got[r[0]] == r[2] for r in rows() if r[0] < 300) >= 0.97 * len(got)


def test_line_dedup(spark, docs):
    got = {r.doc_id: r for r in STAGES["line_dedup"](spark, docs, "").collect()}
    for i, text, _, source, n_chars in rows():
        if source == "s9":
            assert got[i].text == text.split("\n", 1)[1] and got[i].n_chars == len(got[i].text)
        else:
            assert (got[i].text, got[i].n_chars) == (text, n_chars)


def test_near_duplicates(spark, docs):
    got = sorted(r.doc_id for r in STAGES["near_duplicates"](spark, docs, "").collect())
    assert got == sorted(r[0] for r in rows() if not 100 < r[0] < 108)


def test_mixture_keeps_rows_as_they_are(spark, docs):
    got = [tuple(r) for r in STAGES["mixture"](spark, docs, "").collect()]
    assert set(got) <= set(rows()) and 0.25 < len(got) / len(rows()) < 0.75
    assert {301, 302} <= {r[0] for r in got}


def test_sequences_hold_every_document(spark, docs):
    got = STAGES["sequences"](spark, docs, "").collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows()}
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // packing.CAPACITY)


def test_run_chains_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, "").collect(), kept.schema)
    assert got == {r.doc_id for r in kept.collect()} and TOKENIZER


def test_patterns_beat_best_fit():
    """Best fit puts the largest lengths beside the second largest; the fit finds the sets that fill a sequence."""
    histogram = {2112: 6, 1152: 6, 1088: 6, 896: 12}
    shapes = packing.patterns(64)
    import numpy as np

    plain = packing._filled(histogram, packing.CAPACITY, 64, shapes, np.zeros(len(shapes), dtype=np.int64))
    assert sum(n for n, _ in plain) == 11
    assert sum(n for n, _ in packing.plan(histogram)) == 9
