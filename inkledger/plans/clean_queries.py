"""Queries of inspection, cleaning, normalising, rendering and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from ..operators import attachments as at
from ..operators import clean as cl
from ..operators import forensic as fo
from ..sources.tables import MARKED_SQL, read
from .forensic_queries import REPORT_SQL, longs, sql_count, view
from .query import query

_SETS = cl._SETS
_LOOK, _CYR = cs.CYRILLIC_LOOKALIKES, cs.CYRILLIC_EVIDENCE


def sql_without(text: str, characters: str) -> str:
    return f"translate({text}, '{characters}', '')"


def sql_restored(text: str) -> str:
    """Look-alikes in Latin words turned back; `script` is that of the same text, which invisible marks don't change."""
    turned = f"translate(r, '{_LOOK}', '{cs.LATIN_LOOKALIKES}')"
    runs = f"regexp_extract_all({text}, '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string([CASE WHEN NOT regexp_matches(r, '[{_CYR}]') AND (regexp_matches(r, '[{cs.LATIN_LETTERS}]') OR (script = 'latin' AND regexp_matches(r, '[{_LOOK}]'))) THEN {turned} ELSE r END for r in {runs}], '')"


_STRIPPED = sql_without(sql_without(sql_restored(sql_without("marked", _SETS["bidi"])), _SETS["whitespace"]), _SETS["zero_width"])
_CLEAN_SQL = f"{REPORT_SQL}, stripped AS (SELECT *, {_STRIPPED} AS clean FROM reported)"


@query(f"WITH {_CLEAN_SQL} SELECT doc_id, sha256(clean) AS document_hash, CAST(length(clean) AS BIGINT) AS n_chars, clean = cover AS is_cover FROM stripped")
def document_hash(spark, sf_dir):
    rows = view(spark, sf_dir).withColumn("clean", tx.stripped_all(F.col("marked")))
    return rows.select("doc_id", F.sha2("clean", 256).alias("document_hash"), F.length("clean").cast("long").alias("n_chars"), (F.col("clean") == F.col("cover")).alias("is_cover"))


_COUNTS = f"""SELECT doc_id, kind, {", ".join(f"CAST({sql_count('marked', s)} AS BIGINT) AS {c}" for c, s in _SETS.items())}, CAST(substitutions AS BIGINT) AS homoglyph,
CAST({sql_count("marked", cl.UNCLASSED)} AS BIGINT) AS other_invisible FROM reported"""


@query(f"WITH {REPORT_SQL}, counted AS ({_COUNTS}) SELECT *, CASE WHEN bidi + whitespace + zero_width + homoglyph > 0 THEN 'marked' WHEN other_invisible > 0 THEN 'unusual' ELSE 'clean' END AS verdict FROM counted")
def inspect(spark, sf_dir):
    t = F.col("marked")
    rows = view(spark, sf_dir).select("doc_id", "kind", *[v.alias(k) for k, v in cl.class_counts(t).items()], tx.count_of(t, cl.UNCLASSED).alias("other_invisible"))
    marks = F.col("bidi") + F.col("whitespace") + F.col("zero_width") + F.col("homoglyph")
    return rows.withColumn("verdict", F.when(marks > 0, "marked").when(F.col("other_invisible") > 0, "unusual").otherwise("clean"))


@query(f"WITH {_CLEAN_SQL} SELECT doc_id, md5({sql_without('marked', _SETS['bidi'])}) AS no_bidi, md5({sql_restored('marked')}) AS no_homoglyph, md5({sql_without('marked', _SETS['whitespace'])}) AS no_whitespace, md5({sql_without('marked', _SETS['zero_width'])}) AS no_zero_width FROM stripped")
def strip_each(spark, sf_dir):
    names = {"bidi": "no_bidi", "homoglyph": "no_homoglyph", "whitespace": "no_whitespace", "zero_width": "no_zero_width"}
    return view(spark, sf_dir).select("doc_id", *[F.md5(cl.cleaned(F.col("marked"), (c,))).alias(n) for c, n in names.items()])


@query(f"WITH {_CLEAN_SQL} SELECT doc_id, md5({sql_without('clean', cs.FORENSIC)}) AS text_md5, CAST(length(marked) - length({sql_without('clean', cs.FORENSIC)}) AS BIGINT) AS removed, CAST({sql_count('clean', cs.FORENSIC)} AS BIGINT) AS beyond_classes FROM stripped")
def pristine(spark, sf_dir):
    rows = view(spark, sf_dir).withColumn("clean", cl.cleaned(F.col("marked"))).withColumn("p", tx.without(F.col("clean"), cs.FORENSIC))
    return rows.select("doc_id", F.md5("p").alias("text_md5"), (F.length("marked") - F.length("p")).cast("long").alias("removed"), tx.count_of(F.col("clean"), cs.FORENSIC).alias("beyond_classes"))


@query(f"""WITH {_CLEAN_SQL} SELECT doc_id, CAST(CASE WHEN length(marked) <> length(clean) THEN abs(length(marked) - length(clean)) WHEN marked = clean THEN 0
ELSE len([1 for x in list_zip(string_split(marked, ''), string_split(clean, '')) if x[1] <> x[2]]) END AS BIGINT) AS n_changed FROM stripped""")
def count_changed(spark, sf_dir):
    rows = view(spark, sf_dir).withColumn("clean", tx.stripped_all(F.col("marked")))
    return rows.select("doc_id", cl.changed(F.col("marked"), F.col("clean")).alias("n_changed"))


_INVISIBLE_GONE = sql_without("marked", _SETS["bidi"] + _SETS["whitespace"] + _SETS["zero_width"])


@query(f"WITH {REPORT_SQL} SELECT doc_id, CASE WHEN substitutions = 0 THEN 'no_substitution_evidence' END AS refusal, CASE WHEN substitutions > 0 THEN md5({sql_restored(_INVISIBLE_GONE)}) END AS text_md5, md5({_INVISIBLE_GONE}) AS default_md5 FROM reported")
def sanitize(spark, sf_dir):
    rows = cl.sanitized(view(spark, sf_dir), "marked", True).withColumnRenamed("sanitized", "forced").withColumnRenamed("refusal", "forced_refusal")
    rows = cl.sanitized(rows, "marked", False)
    return rows.select("doc_id", F.col("forced_refusal").alias("refusal"), F.md5("forced").alias("text_md5"), F.md5("sanitized").alias("default_md5"))


_NORMAL = f"trim(regexp_replace(regexp_replace(lower(translate(marked, '{cl.ACCENTED}', '{cl.PLAIN}')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"WITH {REPORT_SQL} SELECT doc_id, CASE WHEN invisible + substitutions > 0 THEN 'marks_would_be_lost' END AS refusal, CASE WHEN invisible + substitutions = 0 THEN md5({_NORMAL}) END AS text_md5, md5({_NORMAL}) AS lossy_md5 FROM reported")
def normalize_text(spark, sf_dir):
    rows = cl.normalized(view(spark, sf_dir), "marked").withColumnRenamed("normalized", "strict").withColumnRenamed("refusal", "strict_refusal")
    rows = cl.normalized(rows, "marked", accept_loss=True)
    return rows.select("doc_id", F.col("strict_refusal").alias("refusal"), F.md5("strict").alias("text_md5"), F.md5("normalized").alias("lossy_md5"))


@query(
    f"""WITH {MARKED_SQL}, h AS (SELECT doc_id, list_histogram(string_split(cover, '')) AS a, list_histogram(string_split(marked, '')) AS b FROM marked WHERE cover <> marked),
k AS (SELECT doc_id, a, b, unnest(list_distinct(list_concat(map_keys(a), map_keys(b)))) AS c FROM h),
p AS (SELECT doc_id, c, CAST(coalesce(a[c], 0) AS BIGINT) AS left_n, CAST(coalesce(b[c], 0) AS BIGINT) AS right_n FROM k WHERE c <> '')
SELECT doc_id, 'U+' || lpad(printf('%X', unicode(c)), 4, '0') AS codepoint, left_n, right_n, CASE WHEN right_n > left_n THEN 'gained' ELSE 'lost' END AS change FROM p WHERE left_n <> right_n"""
)
def compare_texts(spark, sf_dir):
    return fo.compared(view(spark, sf_dir))


_ESC = "replace(replace(replace(marked, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH {REPORT_SQL} SELECT doc_id, sha256(marked) AS sha256, CAST(total AS BIGINT) AS chars, CAST(bytes AS BIGINT) AS bytes, md5('<pre>' || {_ESC} || '</pre>') AS html_md5,
md5(base64(encode(marked))) AS base64_md5, md5('data:text/plain;charset=utf-8;base64,' || base64(encode(marked))) AS data_uri_md5, verdict FROM reported""")
def render(spark, sf_dir):
    rows = fo.reported(view(spark, sf_dir))
    return rows.select("doc_id", F.sha2("marked", 256).alias("sha256"), F.col("total").alias("chars"), "bytes", *[F.md5(v).alias(f"{k}_md5") for k, v in at.rendered(F.col("marked")).items()], "verdict")


@query("""WITH a AS (SELECT doc_id, coalesce(text, '') || '[FILE:note' || (doc_id % 3) || '.txt|' || base64(encode('payload ' || doc_id)) || '[/FILE]' || '[FILE:b|' || base64(encode(lang)) || '[/FILE]' AS t, text FROM documents),
x AS (SELECT doc_id, regexp_replace(t, '\\[FILE:[^|\\]]*\\|[A-Za-z0-9+/=]*\\[/FILE\\]', '', 'g') AS rest, text, regexp_extract_all(t, '\\[FILE:([^|\\]]*)\\|([A-Za-z0-9+/=]*)\\[/FILE\\]', 1) AS names, regexp_extract_all(t, '\\[FILE:([^|\\]]*)\\|([A-Za-z0-9+/=]*)\\[/FILE\\]', 2) AS data FROM a)
SELECT doc_id, array_to_string(names, ',') AS names, decode(from_base64(data[1])) AS first_payload, CAST(len(names) AS INTEGER) AS n_attachments, rest = coalesce(text, '') AS restored FROM x""")
def attachments(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.lit("note"), (F.col("doc_id") % 3).cast("string"), F.lit(".txt"))
    t = at.attached(at.attached(F.col("text"), name, F.encode(F.concat(F.lit("payload "), F.col("doc_id").cast("string")), "utf-8")), F.lit("b"), F.encode(F.coalesce("lang", F.lit("")), "utf-8"))
    rows = docs.withColumn("t", t)
    return rows.select(
        "doc_id", F.array_join(at.names(F.col("t")), ",").alias("names"), F.decode(at.payloads(F.col("t"))[0], "utf-8").alias("first_payload"), F.size(at.names(F.col("t"))).alias("n_attachments"), (at.detached(F.col("t")) == F.col("text")).alias("restored")
    )


_FM = "'---' || chr(10) || 'title: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || coalesce(text, '')"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'title: ' || doc_id || chr(10) || 'lang: ' || lang END AS front_matter FROM documents")
def front_matter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    head = F.concat(F.lit("---\ntitle: "), F.col("doc_id").cast("string"), F.lit("\nlang: "), F.col("lang"))
    t = F.concat(head, F.when(F.col("doc_id") % 2 == 0, F.lit("\n---\n")).otherwise(F.lit("\n")), F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^---[ \\t]*$", "--"))
    return docs.select("doc_id", cl.front_matter(t).alias("front_matter"))
