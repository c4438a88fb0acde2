"""The labelled sample: every language, whole rows, and labels of a few words."""

import math
import re

import pytest

from conftest import SF
from inkledger.llm import language

LABELLED = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.mark.parametrize("extra", ["abc", "a", "the and", "zq", "une petite phrase"])
def test_a_label_of_a_few_words_takes_no_text(spark, real, extra):
    sample = {**language.labelled_sample(real), "xx": extra}
    got = language.identified(real, sample).join(real.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_a_mislabelled_document_takes_no_language(spark, real):
    sample = language.labelled_sample(real)
    one = next(r.text for r in real.where("lang = 'en' AND length(text) BETWEEN 400 AND 1500").orderBy("doc_id").limit(1).collect())
    got = language.identified(real.where(real.text != one), {**sample, "xx": one}).join(real.select("doc_id", "lang"), "doc_id").where("lang = 'en' AND lang_pred <> 'und'").collect()
    assert sum(r.lang_pred == "en" for r in got) / len(got) > 0.95


def test_a_small_language_is_still_told(spark, real):
    """Eight lines are enough for texts of a language that no other is like."""
    lines = ["kuwa na siku njema sana leo", "habari ya asubuhi rafiki yangu", "watoto wanacheza mpira uwanjani", "mama anapika chakula cha jioni", "tunakwenda sokoni kununua matunda", "mwalimu anafundisha darasani", "mvua inanyesha tangu asubuhi", "ninapenda kusoma vitabu vya hadithi"]
    sample = {**language.labelled_sample(real), "sw": "\n".join(lines)}
    model = language.model_of(sample)
    assert [p[0] for p in model.predict(["watoto wanapenda kusoma vitabu na kucheza mpira", "mwalimu anakwenda sokoni asubuhi kununua chakula cha watoto"])] == ["sw", "sw"]


def test_every_language_is_learned_from_whole_rows(spark):
    rows = [(i * 400 + k, f"w{chr(97 + k % 26) * 3} lang{'abcdefghij'[i % 10]} " * 5, f"l{i:03d}") for i in range(300) for k in range(3)]
    sample = language.labelled_sample(spark.createDataFrame(rows, LABELLED))
    assert len(sample) == 300
    texts = {r[1] for r in rows}
    assert all(t in texts for s in sample.values() for t in s.split("\n"))


def test_long_rows_are_cut_only_if_nothing_fits(spark):
    long = "ab cd " * 10_000
    rows = [(0, long, "one"), (1, long + "x", "one"), (3, long, "two"), (4, "short text here", "two")]
    sample = language.labelled_sample(spark.createDataFrame(rows, LABELLED))
    assert sample["two"] == "short text here"
    assert sample["one"] == long[: language.MAX_CHARS]


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGS", 3)
    rows = [(k, f"text {k}", f"l{k}") for k in (0, 1, 3, 4, 5, 7, 9)]
    with pytest.raises(ValueError, match="too_many_labels"):
        language.labelled_sample(spark.createDataFrame(rows, LABELLED))


def test_query_against_brute_force(spark, real):
    """Every document of the smallest table: greedy longest matches in segments, costs in bits, the cheapest language."""
    sample = language.labelled_sample(real)
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    bodies = {lang: plain(t) for lang, t in sample.items()}
    known = {c for b in bodies.values() for c in b if c != " "}
    literal, largest = math.log2(len(known) + 2), max(map(len, bodies.values()))

    def parsed(text: str, body: str) -> int:
        count = 0
        for low in range(0, len(text), language.SEGMENT):
            part, at = text[low : low + language.SEGMENT], 0
            while at < len(part):
                n = 1
                while at + n < len(part) and part[at : at + n + 1] in body:
                    n += 1
                count, at = count + 1, at + n
        return count

    want = {}
    for r in real.where("doc_id % 4 = 1").collect():
        text = plain(r.text or "")
        counts = {lang: parsed(text, body) for lang, body in bodies.items()}
        cost = {lang: counts[lang] * (math.log2(max(len(body), language.LEAST_SAMPLE)) + literal) + math.log2(largest / len(body)) for lang, body in bodies.items()}
        best = min(sorted(cost), key=cost.get)
        want[r.doc_id] = (best, counts[best]) if text.strip() else ("und", 0)
    got = {r.doc_id: (r.lang_pred, r.phrases) for r in language.identified(real).where("doc_id % 4 = 1").collect()}
    assert got == want
