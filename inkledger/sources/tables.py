"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their scan fills fewer tasks, as a table of one row group does; larger tables as they lie."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: A sentence of another script, for genuine mixing.
CYRILLIC_SENTENCE = " Это обычный русский текст для проверки."


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, lang, kind, cover, marked: each document with marks of the kind its id gives.

    Kinds: 0 none, 1 zero-width spaces, 2 zero-width bits, 3 Cyrillic look-alikes, 4 direction marks, 5 joiners, 6 soft hyphens
    and zero-width joiners, 7 a Cyrillic sentence at the end. A projection: nothing is shuffled.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    kind = F.pmod("doc_id", F.lit(8)).cast("int")
    swap = lambda a, b: F.replace(F.replace(t, F.lit(" "), F.lit(f" {a}")), F.lit(f", {a}"), F.lit(f", {b}"))
    text = (
        F.when(kind == 1, F.replace(t, F.lit(" "), F.lit(" ​")))
        .when(kind == 2, F.replace(F.replace(t, F.lit(". "), F.lit(". ​")), F.lit(", "), F.lit(", ‌")))
        .when(kind == 3, F.translate(t, "aeo", "аео"))
        .when(kind == 4, swap("‎", "‏"))
        .when(kind == 5, swap("⁠", "﻿"))
        .when(kind == 6, F.replace(t, F.lit("e "), F.lit("e­‍ ")))
        .when(kind == 7, F.concat(t, F.lit(CYRILLIC_SENTENCE)))
        .otherwise(t)
    )
    return docs.select("doc_id", "lang", kind.alias("kind"), t.alias("cover"), text.alias("marked"))


MARKED_SQL = f"""marked AS (SELECT doc_id, lang, CAST(((doc_id % 8) + 8) % 8 AS INTEGER) AS kind, coalesce(text, '') AS cover, CASE ((doc_id % 8) + 8) % 8
WHEN 1 THEN replace(coalesce(text, ''), ' ', ' ​')
WHEN 2 THEN replace(replace(coalesce(text, ''), '. ', '. ​'), ', ', ', ‌')
WHEN 3 THEN translate(coalesce(text, ''), 'aeo', 'аео')
WHEN 4 THEN replace(replace(coalesce(text, ''), ' ', ' ‎'), ', ‎', ', ‏')
WHEN 5 THEN replace(replace(coalesce(text, ''), ' ', ' ⁠'), ', ⁠', ', ﻿')
WHEN 6 THEN replace(coalesce(text, ''), 'e ', 'e­‍ ')
WHEN 7 THEN coalesce(text, '') || '{CYRILLIC_SENTENCE}' ELSE coalesce(text, '') END AS marked FROM documents)"""
