"""How a marked copy differs from its cover: alignment, where marks lie, how dense they are, what an audit sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from . import pairing

#: Marks needed before uniformity can be judged.
LEAST_MARKS = 5


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs (cover, marked) with n, failure, failure_at, insertions and substitutions (see pairing), for any cover."""
    return pairing.measured(pairs, carried=tuple(pairs.columns))


def marks(pairs: DataFrame) -> DataFrame:
    """doc_id, n, k, places, characters, width, window, window_at: the marks of each copy in order, with their places in the cover.

    n is the cover's length, k the number of marks; window is the most marks in a window of width places, from window_at on. Copies without
    marks, and those that can't be paired, are left out.
    """
    return pairing.measured(pairs, "places").where("k > 0").select("doc_id", "n", *pairing.PLACES)


def _summed(values, of=lambda v: v):
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v))


def distribution(marked: DataFrame) -> DataFrame:
    """doc_id, k, ks, critical, uniform, verdict, gap_mean, gap_sd, gap_cv, gap_deviation: uniformity of the marks' places. A projection."""
    n, k = F.col("n"), F.col("k")
    apart = lambda x, i: F.greatest((i + 1) / k - (x + 1) / n, (x + 1) / n - i / k)
    gaps = F.zip_with(F.slice("places", F.lit(2), (k - 1).cast("int")), F.slice("places", F.lit(1), (k - 1).cast("int")), lambda b, a: (b - a).cast("double"))
    rows = marked.where(k >= LEAST_MARKS).select("doc_id", "n", "k", F.greatest(F.array_max(F.transform("places", apart)), F.lit(0.0)).alias("ks"), gaps.alias("gaps"))
    rows = rows.withColumn("gap_mean", _summed("gaps") / (k - 1))
    rows = rows.withColumn("gap_sd", F.sqrt(_summed("gaps", lambda g: (g - F.col("gap_mean")) * (g - F.col("gap_mean"))) / (k - 1))).withColumn("dev", _summed("gaps", lambda g: F.abs(g - n / k)) / (k - 1))
    rows = rows.withColumn("critical", 1.36 / F.sqrt("k")).withColumn("uniform", F.col("ks") <= F.col("critical"))
    verdict = F.when(F.col("uniform"), "clean").when(F.col("ks") >= 0.5, "conspicuous").otherwise("degraded")
    return rows.select("doc_id", "k", "ks", "critical", "uniform", verdict.alias("verdict"), "gap_mean", "gap_sd", tx.share(F.col("gap_sd"), F.col("gap_mean")).alias("gap_cv"), (F.col("dev") / (n / k)).alias("gap_deviation"))


def largest_gap(marked: DataFrame) -> DataFrame:
    """doc_id, positions, starts_at: the longest run without a mark; the first of the longest."""
    run = lambda positions, start: F.struct(positions.cast("long").alias("positions"), (-start).cast("long").alias("minus"))
    before = F.concat(F.array(F.lit(-1).cast("long")), "places")
    after = F.concat("places", F.array("n"))
    best = F.array_max(F.zip_with(before, after, lambda a, b: run(F.greatest(b - a - 1, F.lit(0)), a + 1)))
    return marked.select("doc_id", best.alias("run")).select("doc_id", "run.positions", (-F.col("run.minus")).alias("starts_at"))


def densest_window(marked: DataFrame) -> DataFrame:
    """doc_id, width, most, starts_at: the window of a tenth of the cover, 32 at least, with the most marks; reported if 1.5 times what is expected."""
    dense = (F.col("k") >= LEAST_MARKS) & (F.col("window") > 1.5 * (F.col("k") * F.col("width") / F.col("n")))
    return marked.where(dense).select("doc_id", "width", F.col("window").alias("most"), F.col("window_at").alias("starts_at"))


def density(pairs: DataFrame) -> DataFrame:
    """doc_id, mission, fill, verdict: the share of the cover's places that marks fill, against each mission's ceiling."""
    rows = aligned(pairs).where("failure IS NULL AND n > 0").select("doc_id", "n", (F.col("insertions") + F.col("substitutions")).alias("m"))
    missions = F.array(*[F.struct(F.lit(m).alias("mission"), F.lit(c).alias("ceiling")) for m, c in cs.MISSIONS])
    rows = rows.select("doc_id", "n", "m", F.inline(missions)).withColumn("fill", F.col("m") / F.col("n"))
    over = (F.col("fill") - F.col("ceiling")) / (1 - F.col("ceiling"))
    verdict = F.when(F.col("m") > F.col("n"), "indeterminate").when(F.col("fill") <= F.col("ceiling"), "clean").when(over >= 0.5, "conspicuous").otherwise("degraded")
    return rows.select("doc_id", "mission", "fill", verdict.alias("verdict"))


#: Code points that an audit lists, the most frequent first.
LISTED = 32


def audit(marked: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, codepoint, n, first_at, rank: the code points a copy added, in each row of it, by falling count, then by code point. In the
    row, without a shuffle; all of them, or the first `most`."""
    pairs = F.arrays_zip("characters", "places")
    each = F.transform(
        F.array_distinct("characters"),
        lambda c: F.struct((-F.size(F.filter("characters", lambda x: x == c))).cast("long").alias("minus"), F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")).alias("codepoint"), F.get(F.filter(pairs, lambda p: p["characters"] == c), F.lit(0))["places"].alias("first_at")),
    )
    listed = F.array_sort(each)
    rows = marked.select("doc_id", F.posexplode(F.slice(listed, 1, most) if most else listed))
    return rows.select("doc_id", "col.codepoint", (-F.col("col.minus")).alias("n"), "col.first_at", (F.col("pos") + 1).cast("long").alias("rank"))


def word_selection(pairs: DataFrame) -> DataFrame:
    """doc_id, words, broken, mixed, verdict: words of the cover with a control put inside, and words with letters in others' place."""
    rows = pairing.measured(pairs, "checks").where("failure IS NULL")
    verdict = F.when(F.col("broken") > 0, "conspicuous").when(F.col("mixed") > 0, "degraded").otherwise("clean")
    return rows.select("doc_id", "words", "broken", "mixed", verdict.alias("verdict"))


def bidi_balance(pairs: DataFrame) -> DataFrame:
    """doc_id, added_unclosed, added_orphans, direction_marks, rtl_beside_neutrals, verdict: direction scopes that a copy leaves open beyond its
    cover's, closings without one, and marks from right to left that were put in beside white space or punctuation."""
    rows = pairing.measured(pairs, "checks").where("failure IS NULL")
    verdict = F.when(F.col("unclosed") > 0, "conspicuous").when((F.col("rtl_beside_neutrals") > 0) | (F.col("orphans") > 0), "degraded").otherwise("clean")
    return rows.select("doc_id", F.col("unclosed").alias("added_unclosed"), F.col("orphans").alias("added_orphans"), "direction_marks", "rtl_beside_neutrals", verdict.alias("verdict"))


def reflowed(pairs: DataFrame) -> DataFrame:
    """doc_id, cover_breaks, moved, gained, lost, marks_in_code: line breaks of covers and copies, and marks inside the cover's code."""
    return pairing.measured(pairs, "layout").where("failure IS NULL").select("doc_id", "cover_breaks", "moved", "gained", "lost", "marks_in_code")


# Risks of a reader's finding, by check and verdict; and of marks from right to left beside neutral characters.
RTL_RISK = 0.45
RISKS = {"reflow": {"conspicuous": 1.0, "degraded": 0.4}, "bidi_balance": {"conspicuous": 1.0, "degraded": 0.35}, "word_selection": {"degraded": 0.4}, "paste_safety": {"conspicuous": 1.0}}


def assessed(pairs: DataFrame, mission: str = "conceal") -> DataFrame:
    """doc_id, reader_verdict, reader_risk, worst_check, analyst_exposure, analyst_risk, not_run: all checks of a copy, rolled up.

    pairs: doc_id, cover, marked. The four checks of a reader and the three of an analyst (distribution, density, code points) stand side by
    side in one row: nothing is joined or shuffled, and rows of one id stay apart. A copy that can't be paired with its cover has no
    check that ran; a distribution can't be judged by fewer than LEAST_MARKS marks, nor a density without a place. With a check that
    didn't run the reader's verdict is indeterminate. The largest risk counts, not a mean.
    """
    rows = pairing.measured(pairs, "checks", "layout").withColumn("m", F.col("insertions") + F.col("substitutions"))
    paired, m, n = F.col("failure").isNull(), F.col("m"), F.col("n")
    graded = lambda worst, bad: F.when(paired, F.when(worst, "conspicuous").when(bad, "degraded").otherwise("clean"))
    ceiling = dict(cs.MISSIONS)[mission]
    rows = rows.withColumns({
        "reflow": graded(F.col("moved") > 0, F.col("gained") + F.col("lost") > 0), "bidi_balance": graded(F.col("unclosed") > 0, (F.col("orphans") > 0) | (F.col("rtl_beside_neutrals") > 0)),
        "word_selection": graded(F.col("broken") > 0, F.col("mixed") > 0), "paste_safety": graded(F.col("marks_in_code") > 0, F.lit(False)),
        "ks": F.when(paired & (m >= LEAST_MARKS), F.col("spread")),
        "fill": F.when(paired & (n > 0) & (m <= n), m / n),
    })
    word_risk = 0.5 + 0.5 * F.when(F.col("words") > 0, F.col("broken") / F.col("words")).otherwise(0.0)

    def risk(check: str):
        r = F.lit(0.0)
        for verdict, value in RISKS[check].items():
            r = F.when(F.col(check) == verdict, F.lit(value)).otherwise(r)
        if check == "word_selection":
            return F.when(F.col(check) == "conspicuous", word_risk).otherwise(r)
        return F.when((F.col(check) == "degraded") & (F.col("rtl_beside_neutrals") > 0), F.lit(RTL_RISK)).otherwise(r) if check == "bidi_balance" else r

    each = F.array(*[F.struct(risk(c).alias("risk"), F.lit(-k).alias("order"), F.lit(c).alias("check")) for k, c in enumerate(RISKS)])
    rank = F.greatest(*[F.when(F.col(c) == "conspicuous", 2).when(F.col(c) == "degraded", 1).otherwise(0) for c in RISKS])
    absent = {**{c: ~paired for c in RISKS}, "distribution": F.col("ks").isNull(), "density": F.col("fill").isNull(), "codepoint_audit": ~paired}
    not_run = F.array_compact(F.array(*[F.when(gone, F.lit(c)) for c, gone in absent.items()]))
    exposure = F.when(~paired, "indeterminate").when(m > 0, "exposed").otherwise("not_exposed")
    uneven = F.when(F.col("ks") > 1.36 / F.sqrt(m), F.least(F.col("ks"), F.lit(1.0))).otherwise(0.0)
    over = F.when(F.col("fill") > ceiling, F.least((F.col("fill") - ceiling) / (1 - ceiling), F.lit(1.0))).otherwise(0.0)
    rows = rows.withColumn("worst", F.array_max(each)).withColumn("not_run", not_run)
    verdict = F.when(F.size("not_run") > 0, "indeterminate").when(rank == 2, "conspicuous").when(rank == 1, "degraded").otherwise("clean")
    return rows.select(
        "doc_id", verdict.alias("reader_verdict"), F.when(paired, F.col("worst.risk")).otherwise(0.0).alias("reader_risk"), F.when(paired & (F.col("worst.risk") > 0), F.col("worst.check")).alias("worst_check"),
        exposure.alias("analyst_exposure"), F.when(paired, F.greatest(F.when(m > 0, 1.0).otherwise(0.0), uneven, over)).otherwise(0.0).alias("analyst_risk"), "not_run",
    )


def baseline(texts: DataFrame, column: str = "marked", mission: str = "conceal") -> DataFrame:
    """assessed() of each text against itself without its controls: what it shows before anything is added. Put-in letters can't be seen."""
    return assessed(texts.select("doc_id", tx.without(F.col(column), cs.CONTROL).alias("cover"), F.col(column).alias("marked")), mission)
