"""The named queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, html, jaccard, language, lines, matching, mixing, packing, periods, sstable, suffixes, topk

#: Path of the tokenizer file of the packing and output queries, and of the two that are aligned.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(table(spark, sf_dir, "documents"))
    rates = F.round("rate", 6).alias("rate")
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", rates, "kept")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.written(table(spark, sf_dir, "documents"), TOKENIZER)
    return sstable.read_back(spark, shards)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic(table(spark, sf_dir, "documents"), edited=True)


def op12_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.without_passages(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_aligned(table(spark, sf_dir, "documents"), *ALIGNED)


def queries() -> dict[str, Query]:
    found = (op1_fingerprints, op2_mixing, op3_language, op4_sstable, op5_html, op6_topk, op7_repeats, op8_lines, op9_packing, op10_jaccard, op11_periods, op12_matching, op13_alignment)
    return {f.__name__: f for f in found}


OP2_SQL = f"WITH RECURSIVE {mixing.sql()} SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, kept FROM mixed"

OP6_SQL = """WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
q AS (SELECT DISTINCT vec_id, w FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.w AS query, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

OP8_SQL = f"WITH {lines.sql()} SELECT doc_id, source, text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped FROM lined"


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op6_topk": OP6_SQL, "op8_lines": OP8_SQL}
