"""Queries of measures, Unicode analysis, carriers, detection, score and verdict, over the marked view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from ..operators import forensic as fo
from ..operators.regions import opened, regions_sql
from ..sources.tables import MARKED_SQL, marked, read, spread
from .query import query


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked view, over all cores."""
    return marked(spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text")))


def sql_count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


_LOOK, _CYR = cs.CYRILLIC_LOOKALIKES, cs.CYRILLIC_EVIDENCE
_RUNS = f"regexp_extract_all(marked, '\\p{{L}}*[{_LOOK}]\\p{{L}}*')"
_SCRIPT = f"""CASE WHEN regexp_matches(marked, '[{cs.LATIN_LETTERS}]') AND NOT regexp_matches(marked, '[{_CYR}]') THEN 'latin'
WHEN regexp_matches(marked, '[{_CYR}]') AND NOT regexp_matches(marked, '[{cs.LATIN_LETTERS}]') THEN 'cyrillic' ELSE 'undetermined' END"""
_MARKS = ", ".join(f"{sql_count('marked', ''.join(c[:3]))} AS {k}_marks, {sql_count('marked', ''.join(c[:2]))} AS {k}_bits" for k, c in cs.CARRIERS.items())
_SHARE = "CASE WHEN total > 0 THEN CAST({} AS DOUBLE) / total ELSE 0.0 END"
_POINTS = (
    " + ".join(f"{c}_confidence * 0.6" for c in fo.CARRIER_IDS)
    + f" + least({_SHARE.format('invisible')}, 0.3) * 0.5 + CASE mix WHEN 'homoglyph_substitution' THEN 0.3 WHEN 'mixed_content' THEN 0.1 ELSE 0.0 END"
    + " + CASE WHEN noise_density > 0.01 THEN 0.1 ELSE 0.0 END + CASE WHEN homoglyph_density > 0.01 THEN 0.1 ELSE 0.0 END + CASE WHEN bidi_controls > 0 THEN 0.15 ELSE 0.0 END"
)
#: CTEs up to `reported`.
REPORT_SQL = f"""{MARKED_SQL},
scripted AS (SELECT *, {_SCRIPT} AS script FROM marked),
measured AS (SELECT doc_id, lang, kind, cover, marked, script, length(marked) AS total, strlen(marked) AS bytes, {sql_count("marked", cs.FORENSIC)} AS invisible, {sql_count("marked", cs.METRICS)} AS noise,
{sql_count("marked", cs.BIDI)} AS bidi_controls, {sql_count("marked", cs.JOINERS)} AS word_joiners, length(regexp_replace(marked, '[^A-Za-z]', '', 'g')) AS latin,
length(regexp_replace(marked, '[^Ѐ-ԯ]', '', 'g')) AS cyrillic, {sql_count("marked", cs.LATIN_LOOKALIKES + _LOOK)} AS positions, {_MARKS},
CAST(coalesce(list_sum([CASE WHEN regexp_matches(r, '[{_CYR}]') THEN 0 WHEN regexp_matches(r, '[{cs.LATIN_LETTERS}]') OR script = 'latin' THEN {sql_count("r", _LOOK)} ELSE 0 END for r in {_RUNS}]), 0) AS BIGINT) AS substitutions FROM scripted),
dense AS (SELECT *, {_SHARE.format("noise")} AS noise_density, {_SHARE.format("substitutions")} AS homoglyph_density,
{", ".join(f"least(1.0, {_SHARE.format(f'({c}_marks * {g})')}) AS {c}_confidence" for c, g in cs.GAIN.items())},
least(1.0, CASE WHEN positions > 0 THEN 2.0 * substitutions / positions ELSE 0.0 END) AS homoglyph_confidence,
{", ".join(f"{c}_bits > 0 AND {c}_bits % 8 = 0 AS {c}_decodable" for c in cs.CARRIERS)}, substitutions > 0 AND positions >= 8 AS homoglyph_decodable,
CASE WHEN latin > 0 AND cyrillic > 0 THEN CASE WHEN substitutions > 0 THEN 'homoglyph_substitution' ELSE 'mixed_content' END END AS mix FROM measured),
scored AS (SELECT *, least(1.0, {_POINTS}) AS score FROM dense),
reported AS (SELECT *, CASE WHEN zero_width_decodable OR homoglyph_decodable OR bidi_decodable OR whitespace_var_decodable THEN 'CONFIRMED' WHEN score >= 0.7 THEN 'MODIFIED' WHEN score >= 0.3 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM scored)"""
HISTOGRAM_SQL = "histogram AS (SELECT doc_id, c AS character, count(*) AS n FROM (SELECT doc_id, unnest(string_split(marked, '')) AS c FROM marked) WHERE c <> '' GROUP BY ALL)"
ENTROPY_SQL = "entropies AS (SELECT m.doc_id, coalesce(log2(s) - w / s, 0.0) AS entropy FROM marked m LEFT JOIN (SELECT doc_id, sum(n) AS s, sum(n * log2(n)) AS w FROM histogram GROUP BY doc_id) USING (doc_id))"


def longs(columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns.split())


def rounds(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


def _rounds(columns: str) -> list:
    return [tx.rounded(F.col(c)).alias(c) for c in columns.split()]


@query(f"WITH {REPORT_SQL} SELECT lang, verdict, count(*) AS n_docs, round(avg(score), 6) AS mean_score FROM reported GROUP BY lang, verdict")
def forensic_verdict_by_lang(spark, sf_dir):
    rows = fo.reported(view(spark, sf_dir))
    return rows.groupBy("lang", "verdict").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH {REPORT_SQL} SELECT doc_id, {longs('total invisible bidi_controls word_joiners')}, CAST(total - invisible AS BIGINT) AS visible FROM reported")
def unicode_counts(spark, sf_dir):
    rows = fo.measured(view(spark, sf_dir))
    return rows.select("doc_id", "total", "invisible", "bidi_controls", "word_joiners", (F.col("total") - F.col("invisible")).alias("visible"))


@query(f"WITH {REPORT_SQL} SELECT doc_id, {rounds('noise_density homoglyph_density')}, {longs('substitutions positions')} FROM reported")
def densities(spark, sf_dir):
    return fo.reported(view(spark, sf_dir)).select("doc_id", *_rounds("noise_density homoglyph_density"), "substitutions", "positions")


@query(f"WITH {MARKED_SQL}, {HISTOGRAM_SQL}, {ENTROPY_SQL} SELECT doc_id, round(entropy, 6) AS entropy, CASE WHEN entropy < 2 THEN 'very_low' WHEN entropy < 4 THEN 'normal' WHEN entropy < 5 THEN 'slightly_elevated' WHEN entropy < 6.5 THEN 'elevated' ELSE 'very_high' END AS entropy_class FROM entropies")
def shannon_entropy(spark, sf_dir):
    return fo.entropy(view(spark, sf_dir)).select("doc_id", *_rounds("entropy"), fo.entropy_class().alias("entropy_class"))


@query(f"WITH {REPORT_SQL}, {HISTOGRAM_SQL}, {ENTROPY_SQL} SELECT doc_id, {longs('total bytes')}, {rounds('entropy noise_density homoglyph_density')} FROM reported JOIN entropies USING (doc_id)")
def measure_text(spark, sf_dir):
    docs = fo.with_entropy(view(spark, sf_dir), {"entropy": "marked"})
    return fo.reported(docs).select("doc_id", "total", "bytes", *_rounds("entropy noise_density homoglyph_density"))


@query(
    f"""WITH {REPORT_SQL}, {HISTOGRAM_SQL}, {ENTROPY_SQL}, plain AS (SELECT doc_id, c AS character, count(*) AS n FROM (SELECT doc_id, unnest(string_split(cover, '')) AS c FROM marked) WHERE c <> '' GROUP BY ALL),
before AS (SELECT m.doc_id, coalesce(log2(s) - w / s, 0.0) AS e0 FROM marked m LEFT JOIN (SELECT doc_id, sum(n) AS s, sum(n * log2(n)) AS w FROM plain GROUP BY doc_id) USING (doc_id))
SELECT doc_id, round(entropy - e0, 6) AS entropy_delta, round(noise_density + homoglyph_density, 6) AS density, round((noise_density + homoglyph_density) * 10, 6) AS perplexity_delta, 0.0::DOUBLE AS survival FROM reported JOIN entropies USING (doc_id) JOIN before USING (doc_id)"""
)
def metrics_delta(spark, sf_dir):
    after = fo.reported(fo.with_entropy(view(spark, sf_dir), {"entropy": "marked", "e0": "cover"}))
    density = F.col("noise_density") + F.col("homoglyph_density")
    return after.select("doc_id", tx.rounded(F.col("entropy") - F.col("e0")).alias("entropy_delta"), tx.rounded(density).alias("density"), tx.rounded(density * 10).alias("perplexity_delta"), F.lit(0.0).alias("survival"))


@query(f"WITH {MARKED_SQL}, {HISTOGRAM_SQL} SELECT doc_id, 'U+' || lpad(printf('%X', unicode(character)), 4, '0') AS codepoint, n FROM histogram WHERE contains('{cs.FORENSIC}', character)")
def invisible_breakdown(spark, sf_dir):
    # Only marks are exploded: the rest of the text is cut away in the projection.
    docs = view(spark, sf_dir).select("doc_id", tx.only(F.col("marked"), cs.FORENSIC).alias("marks")).where("marks <> ''")
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("ascii(character)")), 4, "0"))
    return fo.characters(docs, "marks").select("doc_id", code.alias("codepoint"), "n")


CATEGORIES = {"bidi_control": cs.BIDI, "joiner": cs.JOINERS, "zero_width": "​‌‍"}


def _category_sql() -> str:
    return "CASE " + " ".join(f"WHEN contains('{v}', character) THEN '{k}'" for k, v in CATEGORIES.items()) + " ELSE 'other' END"


@query(f"WITH {MARKED_SQL}, {HISTOGRAM_SQL} SELECT 'U+' || lpad(printf('%X', unicode(character)), 4, '0') AS codepoint, {_category_sql()} AS category, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM histogram WHERE contains('{cs.FORENSIC}', character) GROUP BY ALL")
def unusual_characters(spark, sf_dir):
    docs = view(spark, sf_dir).select("doc_id", tx.only(F.col("marked"), cs.FORENSIC).alias("marks")).where("marks <> ''")
    category = F.lit("other")
    for k, v in reversed(CATEGORIES.items()):
        category = F.when(F.contains(F.lit(v), F.col("character")), F.lit(k)).otherwise(category)
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("ascii(character)")), 4, "0"))
    rows = fo.characters(docs, "marks").select(code.alias("codepoint"), category.alias("category"), "n")
    return rows.groupBy("codepoint", "category").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(f"WITH {REPORT_SQL} SELECT doc_id, script, mix, CASE WHEN mix IS NULL THEN NULL WHEN latin >= cyrillic THEN 'Latin' ELSE 'Cyrillic' END AS main_script, CAST(least(latin, cyrillic) AS BIGINT) AS other_letters FROM reported")
def script_mix(spark, sf_dir):
    rows = fo.reported(view(spark, sf_dir))
    main = F.when(F.col("mix").isNotNull(), F.when(F.col("latin") >= F.col("cyrillic"), "Latin").otherwise("Cyrillic"))
    return rows.select("doc_id", "script", "mix", main.alias("main_script"), F.least("latin", "cyrillic").alias("other_letters"))


_CONF = " ".join(f"{c}_confidence" for c in fo.CARRIER_IDS)
_KEPT = "[x for x in [" + ", ".join(_CONF.split()) + "] if x > 0.01]"


@query(f"WITH {REPORT_SQL} SELECT doc_id, {rounds(_CONF)}, CAST(len({_KEPT}) AS INTEGER) AS n_detected, round(coalesce(list_avg({_KEPT}), 0.0), 6) AS overall FROM reported")
def detect(spark, sf_dir):
    rows = fo.reported(view(spark, sf_dir))
    kept = F.filter(F.array(*[F.col(c) for c in _CONF.split()]), lambda x: x > 0.01)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", *_rounds(_CONF), F.size(kept).alias("n_detected"), tx.rounded(tx.share(total, F.size(kept))).alias("overall"))


_DEC = " ".join(f"{c}_decodable" for c in fo.CARRIER_IDS)


@query(f"WITH {REPORT_SQL} SELECT doc_id, kind, round(score, 6) AS score, verdict, {', '.join(_DEC.split())} FROM reported")
def analyze(spark, sf_dir):
    return fo.reported(view(spark, sf_dir)).select("doc_id", "kind", *_rounds("score"), "verdict", *_DEC.split())


@query(f"""WITH {REPORT_SQL} SELECT doc_id, array_to_string([x for x in ['verdict ' || verdict, CASE WHEN invisible > 0 THEN invisible || ' invisible characters' END, CASE WHEN bidi_controls > 0 THEN bidi_controls || ' direction controls' END,
CASE WHEN mix IS NOT NULL THEN 'scripts mixed: ' || mix END, CASE WHEN homoglyph_density > 0.01 THEN 'look-alikes in Latin words' END] if x IS NOT NULL], '; ') AS summary FROM reported""")
def summary(spark, sf_dir):
    said = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(what)))
    lines = F.concat_ws(
        "; ", F.concat(F.lit("verdict "), "verdict"), said("invisible", " invisible characters"), said("bidi_controls", " direction controls"),
        F.when(F.col("mix").isNotNull(), F.concat(F.lit("scripts mixed: "), "mix")), F.when(F.col("homoglyph_density") > 0.01, F.lit("look-alikes in Latin words")),
    )
    return fo.reported(view(spark, sf_dir)).select("doc_id", lines.alias("summary"))


def _sql_bits(carrier: str) -> str:
    if carrier == "homoglyph":
        both = cs.LATIN_LOOKALIKES + _LOOK
        return f"translate(regexp_replace(open, '[^{both}]', '', 'g'), '{both}', '{'0' * 24 + '1' * 24}')"
    zero, one, *_ = cs.CARRIERS[carrier]
    return f"translate(regexp_replace(marked, '[^{zero}{one}]', '', 'g'), '{zero}{one}', '01')"


@query(f"WITH RECURSIVE {MARKED_SQL}, {regions_sql('marked')} SELECT doc_id, " + ", ".join(f"CAST(length({_sql_bits(c)}) AS BIGINT) AS {c}_n, md5({_sql_bits(c)}) AS {c}_md5" for c in fo.CARRIER_IDS) + " FROM opened")
def read_bits(spark, sf_dir):
    """The bits of all carriers; look-alike letters of protected regions are none."""
    both = [(c, tx.bits(F.col("open" if c == "homoglyph" else "marked"), c)) for c in fo.CARRIER_IDS]
    return opened(view(spark, sf_dir).select("doc_id", "marked"), "marked").select("doc_id", *[x for c, b in both for x in (F.length(b).cast("long").alias(f"{c}_n"), F.md5(b).alias(f"{c}_md5"))])


@query(f"WITH {REPORT_SQL} SELECT doc_id, c AS carrier, n AS bits, CASE WHEN n = 0 THEN 'no_marks' WHEN n % 8 <> 0 THEN 'partial_byte' END AS refusal, CASE WHEN n % 8 = 0 THEN CAST(n // 8 AS BIGINT) ELSE 0 END AS bytes FROM (SELECT doc_id, unnest(['zero_width', 'whitespace_var', 'bidi']) AS c, CAST(unnest([zero_width_bits, whitespace_var_bits, bidi_bits]) AS BIGINT) AS n FROM reported)")
def decode_sizes(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(c).alias("carrier"), F.col(f"{c}_bits").alias("bits")) for c in cs.CARRIERS])
    rows = fo.measured(view(spark, sf_dir)).select("doc_id", F.inline(pairs))
    n = F.col("bits")
    refusal = F.when(n == 0, "no_marks").when(n % 8 != 0, "partial_byte")
    return rows.select("doc_id", "carrier", "bits", refusal.alias("refusal"), F.when(n % 8 == 0, (n / 8).cast("long")).otherwise(F.lit(0).cast("long")).alias("bytes"))


@query(f"WITH {REPORT_SQL} SELECT doc_id, " + ", ".join(f"CASE WHEN {c}_marks > 0 THEN 'occupied:' || {c}_marks END AS {c}_refusal" for c in cs.CARRIERS) + " FROM reported")
def check_writable(spark, sf_dir):
    rows = fo.measured(view(spark, sf_dir))
    return rows.select("doc_id", *[F.when(F.col(f"{c}_marks") > 0, F.concat(F.lit("occupied:"), F.col(f"{c}_marks").cast("string"))).alias(f"{c}_refusal") for c in cs.CARRIERS])
