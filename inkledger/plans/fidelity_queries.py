"""Queries of fidelity: a marked copy against its cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..operators import codec
from ..operators import fidelity as fi
from ..operators.regions import regions_sql
from ..sources.tables import MARKED_SQL
from .forensic_queries import _rounds, rounds, sql_count, view
from .query import query

_SK = f"translate(marked, '{cs.CONTROL}', '')"
ALIGN_SQL = f"""{MARKED_SQL}, al0 AS (SELECT *, length(cover) AS n, {_SK} AS skeleton, CASE WHEN length({_SK}) > length(cover) THEN 'visible_content_added' WHEN length({_SK}) < length(cover) THEN 'cover_content_missing' END AS failure FROM marked),
aligned AS (SELECT *, CASE WHEN failure IS NULL THEN {sql_count("marked", cs.CONTROL)} END AS insertions, CASE WHEN failure IS NULL THEN CASE WHEN skeleton = cover THEN 0 ELSE len([1 for z in list_zip(string_split(skeleton, ''), string_split(cover, '')) if z[1] <> z[2]]) END END AS substitutions FROM al0)"""
MARKS_SQL = f"""{ALIGN_SQL}, chars AS (SELECT doc_id, n, unnest(string_split(marked, '')) AS character, generate_subscripts(string_split(marked, ''), 1) - 1 AS pos FROM aligned WHERE failure IS NULL AND insertions + substitutions > 0),
found AS (SELECT *, CASE WHEN contains('{cs.CONTROL}', character) THEN 1 ELSE 0 END AS ins FROM chars WHERE character <> '' AND contains('{cs.CONTROL + cs.CYRILLIC_LOOKALIKES}', character)),
marks AS (SELECT doc_id, CAST(n AS BIGINT) AS n, character, CAST(pos - coalesce(sum(ins) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS k FROM found)"""


@query(f"WITH {ALIGN_SQL} SELECT doc_id, CAST(n AS BIGINT) AS n, failure, CAST(coalesce(insertions, -1) AS BIGINT) AS insertions, CAST(coalesce(substitutions, -1) AS BIGINT) AS substitutions FROM aligned")
def fidelity_align(spark, sf_dir):
    return fi.aligned(view(spark, sf_dir)).select("doc_id", "n", "failure", F.coalesce("insertions", F.lit(-1)).alias("insertions"), F.coalesce("substitutions", F.lit(-1)).alias("substitutions"))


_DIST = f"""{MARKS_SQL}, gapped AS (SELECT *, x - lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS gap, greatest(i / k - (x + 1) / n, (x + 1) / n - (i - 1) / k) AS d FROM marks WHERE k >= 5),
dist AS (SELECT doc_id, k, greatest(max(d), 0.0) AS ks, 1.36 / sqrt(k) AS critical, avg(gap) AS gap_mean, stddev_pop(gap) AS gap_sd, avg(abs(gap - n / k)) / (max(n) / k) AS gap_deviation FROM gapped GROUP BY doc_id, k)"""


@query(f"WITH {_DIST} SELECT doc_id, k, {rounds('ks critical gap_mean gap_sd gap_deviation')}, ks <= critical AS uniform, CASE WHEN ks <= critical THEN 'clean' WHEN ks >= 0.5 THEN 'conspicuous' ELSE 'degraded' END AS verdict, round(CASE WHEN gap_mean > 0 THEN gap_sd / gap_mean ELSE 0.0 END, 6) AS gap_cv FROM dist")
def fidelity_distribution(spark, sf_dir):
    return fi.distribution(fi.marks(view(spark, sf_dir))).select("doc_id", "k", *_rounds("ks critical gap_mean gap_sd gap_deviation gap_cv"), "uniform", "verdict")


@query(
    f"""WITH {MARKS_SQL}, lagged AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM marks),
runs AS (SELECT doc_id, CASE WHEN i = 1 THEN x ELSE greatest(x - p - 1, 0) END AS positions, CASE WHEN i = 1 THEN 0 ELSE p + 1 END AS starts_at FROM lagged UNION ALL SELECT doc_id, greatest(n - x - 1, 0), x + 1 FROM lagged WHERE i = k),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY positions DESC, starts_at) AS place FROM runs) SELECT doc_id, CAST(positions AS BIGINT) AS positions, CAST(starts_at AS BIGINT) AS starts_at FROM best WHERE place = 1"""
)
def fidelity_largest_gap(spark, sf_dir):
    return fi.largest_gap(fi.marks(view(spark, sf_dir)))


@query(
    f"""WITH {MARKS_SQL}, wide AS (SELECT *, CAST(least(greatest(n // 10, 32), n) AS BIGINT) AS width FROM marks WHERE k >= 5),
ends AS (SELECT doc_id, n, k, width, x AS spot, 1 AS opens, x AS starts_at FROM wide UNION ALL SELECT doc_id, n, k, width, x + width, 0, x FROM wide),
seen AS (SELECT *, coalesce(sum(opens) OVER (PARTITION BY doc_id ORDER BY spot RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM ends),
m AS (SELECT doc_id, n, k, width, starts_at, max(seen) FILTER (WHERE opens = 0) - min(seen) FILTER (WHERE opens = 1) AS m FROM seen GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, starts_at) AS place FROM m)
SELECT doc_id, width, CAST(m AS BIGINT) AS most, starts_at FROM best WHERE place = 1 AND m > 1.5 * k * width / n"""
)
def fidelity_densest_window(spark, sf_dir):
    return fi.densest_window(fi.marks(view(spark, sf_dir)))


_M = ", ".join(f"('{m}', {c})" for m, c in cs.MISSIONS)


@query(f"WITH {ALIGN_SQL}, missions(mission, ceiling) AS (VALUES {_M}), d AS (SELECT doc_id, mission, CAST(ceiling AS DOUBLE) AS c, insertions + substitutions AS m, n, (insertions + substitutions) / n AS fill FROM aligned, missions WHERE failure IS NULL AND n > 0) SELECT doc_id, mission, round(fill, 6) AS fill, CASE WHEN m > n THEN 'indeterminate' WHEN fill <= c THEN 'clean' WHEN (fill - c) / (1 - c) >= 0.5 THEN 'conspicuous' ELSE 'degraded' END AS verdict FROM d")
def fidelity_density(spark, sf_dir):
    return fi.density(view(spark, sf_dir)).select("doc_id", "mission", *_rounds("fill"), "verdict")


@query(f"WITH {MARKS_SQL} SELECT doc_id, 'U+' || lpad(printf('%X', unicode(character)), 4, '0') AS codepoint, count(*) AS n, CAST(min(x) AS BIGINT) AS first_at FROM marks GROUP BY ALL")
def fidelity_audit(spark, sf_dir):
    return fi.audit(fi.marks(view(spark, sf_dir))).drop("rank")


@query(f"WITH {MARKS_SQL}, counted AS (SELECT doc_id, 'U+' || lpad(printf('%X', unicode(character)), 4, '0') AS codepoint, count(*) AS n, CAST(min(x) AS BIGINT) AS first_at FROM marks GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, codepoint) AS rank FROM counted) SELECT * FROM ranked WHERE rank <= 2")
def fidelity_audit_most(spark, sf_dir):
    """The two code points that each copy added most."""
    return fi.audit(fi.marks(view(spark, sf_dir)), 2)


_W = "[\\p{L}\\p{N}_]"
_BROKEN = f"len(regexp_extract_all(marked, '{_W}+(?:[{cs.CONTROL}]+{_W}+)+'))"
_MIXED = f"CASE WHEN substitutions > 0 THEN len([1 for w in regexp_extract_all(skeleton, '{_W}+') if regexp_matches(w, '[{cs.CYRILLIC_LOOKALIKES}]')]) ELSE 0 END"


@query(f"WITH {ALIGN_SQL} SELECT doc_id, CAST(len(regexp_extract_all(cover, '{_W}+')) AS BIGINT) AS words, CAST({_BROKEN} AS BIGINT) AS broken, CAST({_MIXED} AS BIGINT) AS mixed, CASE WHEN {_BROKEN} > 0 THEN 'conspicuous' WHEN {_MIXED} > 0 THEN 'degraded' ELSE 'clean' END AS verdict FROM aligned WHERE failure IS NULL")
def fidelity_word_selection(spark, sf_dir):
    return fi.word_selection(view(spark, sf_dir))


_SCOPED = "CASE doc_id % 4 WHEN 0 THEN '‪' || cover WHEN 1 THEN cover || '‬' WHEN 2 THEN '⁦' || cover || '⁩' ELSE '⁧' || cover || '‬' END"


@query(f"WITH {MARKED_SQL} SELECT doc_id, CAST(CASE WHEN doc_id % 4 IN (0, 3) THEN 1 ELSE 0 END AS BIGINT) AS added_unclosed, CAST(CASE WHEN doc_id % 4 IN (1, 3) THEN 1 ELSE 0 END AS BIGINT) AS added_orphans, CASE WHEN doc_id % 4 IN (0, 3) THEN 'conspicuous' WHEN doc_id % 4 = 1 THEN 'degraded' ELSE 'clean' END AS verdict FROM marked")
def fidelity_bidi_balance(spark, sf_dir):
    k, c = F.col("doc_id") % 4, F.col("cover")
    text = F.when(k == 0, F.concat(F.lit("‪"), c)).when(k == 1, F.concat(c, F.lit("‬"))).when(k == 2, F.concat(F.lit("⁦"), c, F.lit("⁩"))).otherwise(F.concat(F.lit("⁧"), c, F.lit("‬")))
    return fi.bidi_balance(view(spark, sf_dir).withColumn("marked", text)).select("doc_id", "added_unclosed", "added_orphans", "verdict")


_RTL = "CASE WHEN kind = 0 THEN replace(cover, 'e', 'e‏') ELSE marked END"
_BESIDE = f"CASE WHEN kind = 0 THEN len(regexp_extract_all(cover, 'e[^\\p{{L}}\\p{{N}}]')) ELSE {sql_count('marked', '‏')} END"
_ADDED = f"CASE WHEN kind = 0 THEN {sql_count('cover', 'e')} ELSE {sql_count('marked', '‎‏')} END"


@query(
    f"""WITH {MARKED_SQL}, b AS (SELECT doc_id, CAST({_ADDED} AS BIGINT) AS direction_marks, CAST({_BESIDE} AS BIGINT) AS rtl_beside_neutrals, CAST(CASE WHEN (doc_id // 8) % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS added_unclosed, CAST(CASE WHEN (doc_id // 8) % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS added_orphans FROM marked WHERE kind <> 7)
SELECT *, CASE WHEN added_unclosed > 0 THEN 'conspicuous' WHEN rtl_beside_neutrals > 0 OR added_orphans > 0 THEN 'degraded' ELSE 'clean' END AS verdict FROM b"""
)
def fidelity_direction_marks(spark, sf_dir):
    """Marks from right to left beside neutral characters in marked copies, some of them in scopes left open or closed twice."""
    rows, scope = view(spark, sf_dir), F.floor(F.col("doc_id") / 8) % 3
    text = F.when(F.col("kind") == 0, F.replace("cover", F.lit("e"), F.lit("e‏"))).otherwise(F.col("marked"))
    return fi.bidi_balance(rows.withColumn("marked", F.when(scope == 1, F.concat(F.lit("⁧"), text)).when(scope == 2, F.concat(text, F.lit("‬"))).otherwise(text)))


#: Covers that hold marks already, with more of them, fewer, other letters, or more or less text.
_AGAIN = "CASE (doc_id // 8) % 5 WHEN 0 THEN replace(marked, ', ', ', ​‌') WHEN 1 THEN translate(marked, '‌⁠', '') WHEN 2 THEN translate(marked, 'aeo', 'аео') WHEN 3 THEN marked || '​!' ELSE substr(marked, 1, length(marked) - 1) END"
_CELL = f"'[{cs.CONTROL}]*[^{cs.CONTROL}]'"
_LEFT = "list_reduce(string_split(mm, ''), lambda rem, ch: CASE WHEN ch <> '' AND starts_with(rem, ch) THEN substr(rem, 2) ELSE rem END, cc)"
REALIGN_SQL = f"""{MARKED_SQL}, again AS (SELECT doc_id, marked AS cover, {_AGAIN} AS again FROM marked),
cells AS (SELECT *, regexp_extract_all(cover || chr(57344), {_CELL}) AS gc, regexp_extract_all(again || chr(57344), {_CELL}) AS gm FROM again),
gaps AS (SELECT doc_id, k, left(gc[k], -1) AS cc, left(gm[k], -1) AS mm FROM (SELECT doc_id, gc, gm, unnest(range(1, least(len(gc), len(gm)) + 1)) AS k FROM cells) WHERE length(gc[k]) > 1),
missing AS (SELECT doc_id, min(k) AS f FROM gaps WHERE cc <> mm AND {_LEFT} <> '' GROUP BY doc_id),
judged AS (SELECT c.*, CASE WHEN f < len(gm) THEN 'cover_control_missing' WHEN len(gm) > len(gc) THEN 'visible_content_added' WHEN len(gm) < len(gc) OR f IS NOT NULL THEN 'cover_content_missing' END AS failure FROM cells c LEFT JOIN missing m ON c.doc_id = m.doc_id)"""


@query(
    f"""WITH {REALIGN_SQL} SELECT doc_id, CAST(length(cover) AS BIGINT) AS n, failure, CAST(CASE WHEN failure IS NULL THEN {sql_count("again", cs.CONTROL)} - {sql_count("cover", cs.CONTROL)} ELSE -1 END AS BIGINT) AS insertions,
CAST(CASE WHEN failure IS NULL THEN len([1 for z in list_zip(gc, gm) if right(z[1], 1) <> right(z[2], 1)]) ELSE -1 END AS BIGINT) AS substitutions FROM judged"""
)
def fidelity_align_marked_covers(spark, sf_dir):
    """Pairing with covers that hold controls and look-alikes themselves."""
    step, m = F.floor(F.col("doc_id") / 8) % 5, F.col("marked")
    text = (
        F.when(step == 0, F.replace(m, F.lit(", "), F.lit(", ​‌"))).when(step == 1, F.translate(m, "‌⁠", "")).when(step == 2, F.translate(m, "aeo", "аео"))
        .when(step == 3, F.concat(m, F.lit("​!"))).otherwise(F.substring(m, F.lit(1), F.length(m) - 1))
    )
    rows = fi.aligned(view(spark, sf_dir).select("doc_id", m.alias("cover"), text.alias("marked")))
    return rows.select("doc_id", "n", "failure", F.coalesce("insertions", F.lit(-1)).alias("insertions"), F.coalesce("substitutions", F.lit(-1)).alias("substitutions"))


@query()
def fidelity_reflow(spark, sf_dir):
    """Line breaks at 80 columns in cover and copy, how many moved, and break opportunities gained and lost."""
    return fi.reflowed(view(spark, sf_dir)).drop("marks_in_code")


_HELD = f"CASE WHEN substr(marked, lows[i], 1) IN ('`', '~') THEN {sql_count('substr(marked, lows[i], highs[i] - lows[i])', cs.CONTROL)} ELSE 0 END"


@query(f"WITH RECURSIVE {MARKED_SQL}, {regions_sql('marked')} SELECT m.doc_id, CAST(coalesce(len(lows), 0) AS BIGINT) AS n_regions, CAST(coalesce(list_sum([highs[i] - lows[i] for i in range(1, len(lows) + 1)]), 0) AS BIGINT) AS covered, CAST(coalesce(list_sum([{_HELD.replace('marked', 'r.marked')} for i in range(1, len(lows) + 1)]), 0) AS BIGINT) AS marks_in_code FROM marked m LEFT JOIN regions r ON m.doc_id = r.doc_id")
def protected_regions(spark, sf_dir):
    """Fences, code spans and maths of every text, the characters they cover, and marks that fell inside code."""
    covered = F.aggregate("regions", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return codec.regions(view(spark, sf_dir)).select("doc_id", F.size("regions").cast("long").alias("n_regions"), covered.alias("covered"), "marks_in_code")


@query()
def fidelity_assess(spark, sf_dir):
    """The roll-up: what a reader and what an analyst may notice, with the checks that could not run."""
    return fi.assessed(view(spark, sf_dir))


@query()
def fidelity_baseline(spark, sf_dir):
    """The roll-up of every marked text against itself without its controls."""
    return fi.baseline(view(spark, sf_dir))
