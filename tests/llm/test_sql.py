"""Queries with a SQL twin, and the pipeline as a whole."""

import pytest

from conftest import SF
from inkledger.llm import queries
from test_oracles import rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_raking_meets_its_targets(spark):
    from inkledger.llm import mixing

    rows_ = [(s, lang, t, float(10 + 7 * i)) for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in ("en", "de") for t in ("x", "y"))]
    cells = spark.createDataFrame([(*r, 1) for r in rows_], "d_source string, d_lang string, d_topic string, tokens double, n_docs long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"x": 0.2, "y": 0.8}}
    got = mixing.raked(cells, targets).collect()
    for d, want in targets.items():
        for value, share in want.items():
            assert abs(sum(r.weight for r in got if r[f"d_{d}"] == value) - share) < 1e-8
    assert all(0 <= r.rate <= 1 for r in got)
