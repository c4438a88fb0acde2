"""Texts without their protected regions, and marks that leave those alone."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from ..functions.batches import mapped
from . import codec

#: Stands for a region in an opened text: a code point that is no character.
HOLE = "﷐"
#: What a text with a region holds one of.
MARKERS = ("$", "`", "~~~", "\\[", "\\(")


def may_have_regions(text: str) -> bool:
    return any(m in text for m in MARKERS)


def opened_text(text: str) -> str:
    """The text with a HOLE for each region."""
    if not may_have_regions(text):
        return text
    out, at = [], 0
    for low, high, _ in codec.protected(text):
        out.append(text[at:low])
        at = high
    return HOLE.join([*out, text[at:]])


def opened(docs: DataFrame, column: str, name: str = "open") -> DataFrame:
    """docs with the column's text, each protected region of which is a HOLE. One Arrow pass; nothing is shuffled."""
    at = docs.columns.index(column)
    schema = docs.withColumn(name, F.lit("")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = pa.array([opened_text(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return mapped(docs, run, schema)


def slots(open_: Column) -> Column:
    """Gaps of an opened text, ends included, that are neither inside a word nor in or at a region; controls don't count."""
    s = tx.without(open_, cs.CONTROL)
    words = F.regexp_count(s, F.lit("[\\p{IsAlphabetic}\\p{N}_]+"))
    inside = F.length(F.regexp_replace(s, "[^\\p{IsAlphabetic}\\p{N}_]", ""))
    # Gaps at a run of holes: one more than it has.
    shut = F.when(F.contains(s, F.lit(HOLE)), tx.count_of(s, HOLE) + F.regexp_count(s, F.lit(f"{HOLE}+"))).otherwise(F.lit(0))
    return (F.length(s) + 1 - inside + words - shut).cast("long")


#: The same in DuckDB's SQL, ending in `opened` (doc_id, cover, open) of `marked`: one step of a recursive walk a marker, of texts that hold one.
REGIONS_SQL = rf"""walk AS (SELECT doc_id, cover, CAST(1 AS BIGINT) AS here, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high FROM marked WHERE regexp_matches(cover, '[$`]|~~~|\\[\[(]')
UNION ALL SELECT doc_id, cover, coalesce(high, skip), CASE WHEN high IS NOT NULL THEN p END, high FROM (
SELECT *, CASE WHEN fence THEN CASE WHEN k = 0 THEN length(cover) + 1 ELSE p + k + 6 END
WHEN c = '`' THEN CASE WHEN k > 0 AND NOT contains(substr(cover, p, w + k - 1), chr(10)) THEN p + 2 * w + k - 1 END
WHEN c = '\' THEN CASE WHEN w = 2 AND k > 0 THEN p + k + 3 END
WHEN c = '$' THEN CASE WHEN k > 1 AND (w = 2 OR NOT (regexp_matches(inn, '^[\s\p{{Z}}\x1c-\x1f\x85]') OR regexp_matches(inn, '[\s\p{{Z}}\x1c-\x1f\x85]$') OR contains(inn, chr(10) || chr(10)))) THEN p + 2 * w + k - 1 END END AS high,
p + CASE WHEN c IN ('`', '$') THEN w ELSE 1 END AS skip FROM (
SELECT *, CASE WHEN c = '$' THEN substr(cover, p + w, k - 1) ELSE '' END AS inn FROM (
SELECT *, CASE WHEN fence THEN instr(substr(cover, p + 3), chr(10) || repeat(c, 3)) WHEN c IN ('`', '$') THEN instr(substr(cover, p + w), repeat(c, w)) WHEN c = '\' AND w = 2 THEN instr(substr(cover, p + 2), CASE WHEN substr(cover, p + 1, 1) = '[' THEN '\]' ELSE '\)' END) ELSE 0 END AS k FROM (
SELECT *, c IN ('`', '~') AND substr(cover, p, 3) = repeat(c, 3) AND regexp_matches(substr(cover, 1, p - 1), '(^|\n) *$') AS fence,
CASE c WHEN '`' THEN length(regexp_extract(substr(cover, p), '^`+')) WHEN '$' THEN CASE WHEN substr(cover, p, 2) = '$$' THEN 2 ELSE 1 END WHEN '\' THEN CASE WHEN substr(cover, p + 1, 1) IN ('[', '(') THEN 2 ELSE 1 END ELSE 1 END AS w FROM (
SELECT doc_id, cover, p, substr(cover, p, 1) AS c FROM (SELECT doc_id, cover, here + length(regexp_extract(substr(cover, here), '^[^$`~\\]*')) AS p FROM walk) WHERE p <= length(cover))))))),
regions AS (SELECT doc_id, any_value(cover) AS cover, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs FROM walk WHERE low IS NOT NULL GROUP BY doc_id),
opened AS (SELECT m.doc_id, m.cover, CASE WHEN r.lows IS NULL THEN m.cover ELSE array_to_string([substr(m.cover, CASE WHEN i = 1 THEN 1 ELSE r.highs[i - 1] END, CASE WHEN i > len(r.lows) THEN length(m.cover) + 1 ELSE r.lows[i] END - CASE WHEN i = 1 THEN 1 ELSE r.highs[i - 1] END) for i in range(1, len(r.lows) + 2)], '{HOLE}') END AS open FROM marked m LEFT JOIN regions r USING (doc_id))"""


def regions_sql(column: str = "cover") -> str:
    """REGIONS_SQL over another column of `marked`."""
    return REGIONS_SQL.replace("cover", column)
