"""The forensic report of a text as columns: counts, densities, carriers, score and verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from ..functions.batches import mapped

CARRIER_IDS = ("zero_width", "homoglyph", "bidi", "whitespace_var")


def measured(docs: DataFrame, column: str = "marked") -> DataFrame:
    """docs with counts of characters and marks. One projection, no shuffle."""
    t = F.col(column)
    return docs.select(
        "*",
        F.length(t).cast("long").alias("total"),
        F.octet_length(t).cast("long").alias("bytes"),
        tx.count_of(t, cs.FORENSIC).alias("invisible"),
        tx.count_of(t, cs.METRICS).alias("noise"),
        tx.count_of(t, cs.BIDI).alias("bidi_controls"),
        tx.count_of(t, cs.JOINERS).alias("word_joiners"),
        F.regexp_count(t, F.lit("[A-Za-z]")).cast("long").alias("latin"),
        tx.count_of(t, cs.CYRILLIC_LETTERS + "".join(map(chr, range(0x482, 0x48A)))).alias("cyrillic"),
        tx.document_script(t).alias("script"),
        tx.substitutions(t).alias("substitutions"),
        tx.positions(t).alias("positions"),
        *[tx.count_of(t, "".join(cs.CARRIERS[c][:3])).alias(f"{c}_marks") for c in cs.CARRIERS],
        *[tx.count_of(t, "".join(cs.CARRIERS[c][:2])).alias(f"{c}_bits") for c in cs.CARRIERS],
    )


def reported(docs: DataFrame, column: str = "marked") -> DataFrame:
    """measured() with densities, confidences, decodable flags, score and verdict."""
    rows = measured(docs, column)
    densities = {"noise_density": F.col("noise"), "homoglyph_density": F.col("substitutions")}
    rows = rows.withColumns({k: tx.share(v, F.col("total")) for k, v in densities.items()})
    confidence = {f"{c}_confidence": F.least(F.lit(1.0), tx.share(F.col(f"{c}_marks") * g, F.col("total"))) for c, g in cs.GAIN.items()}
    confidence["homoglyph_confidence"] = F.least(F.lit(1.0), tx.share(2.0 * F.col("substitutions"), F.col("positions")))
    whole_bytes = {f"{c}_decodable": (F.col(f"{c}_bits") > 0) & (F.col(f"{c}_bits") % 8 == 0) for c in cs.CARRIERS}
    whole_bytes["homoglyph_decodable"] = (F.col("substitutions") > 0) & (F.col("positions") >= 8)
    rows = rows.withColumns(confidence | whole_bytes)
    mixed = (F.col("latin") > 0) & (F.col("cyrillic") > 0)
    rows = rows.withColumn("mix", F.when(mixed, F.when(F.col("substitutions") > 0, "homoglyph_substitution").otherwise("mixed_content")))
    points = [F.col(f"{c}_confidence") * 0.6 for c in CARRIER_IDS]
    points.append(F.least(tx.share(F.col("invisible"), F.col("total")), F.lit(0.3)) * 0.5)
    points.append(F.when(F.col("mix") == "homoglyph_substitution", 0.3).when(F.col("mix") == "mixed_content", 0.1).otherwise(0.0))
    points += [F.when(F.col(d) > 0.01, 0.1).otherwise(0.0) for d in densities]
    points.append(F.when(F.col("bidi_controls") > 0, 0.15).otherwise(0.0))
    score = points[0]
    for p in points[1:]:
        score = score + p
    rows = rows.withColumn("score", F.least(F.lit(1.0), score))
    decodable = F.col("zero_width_decodable") | F.col("homoglyph_decodable") | F.col("bidi_decodable") | F.col("whitespace_var_decodable")
    verdict = F.when(decodable, "CONFIRMED").when(F.col("score") >= 0.7, "MODIFIED").when(F.col("score") >= 0.3, "SUSPICIOUS").otherwise("CLEAN")
    return rows.withColumn("verdict", verdict)


def characters(docs: DataFrame, column: str = "marked", id_col: str = "doc_id") -> DataFrame:
    """doc_id, character, n: the histogram of code points. Counts are summed in the tasks before the shuffle."""
    rows = docs.select(id_col, F.explode(F.split(column, "")).alias("character")).where("character <> ''")
    return rows.groupBy(id_col, "character").agg(F.count("*").alias("n"))


def compared(pairs: DataFrame, left: str = "cover", right: str = "marked", id_col: str = "doc_id") -> DataFrame:
    """id, codepoint, left_n, right_n, change: code points that occur more or less often in one of two texts than in the other, in each row.

    Row by row in one Arrow pass: rows of one id stay apart, nothing is shuffled, and only differences come back. Null texts are empty.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, codes, counts = [], [], []
            for k, both in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if both[0] == both[1]:
                    continue
                of = [np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True) for t in both]
                met = np.union1d(of[0][0], of[1][0])
                n = np.zeros((2, len(met)), dtype=np.int64)
                for side, (code, count) in enumerate(of):
                    n[side, np.searchsorted(met, code)] = count
                unlike = np.flatnonzero(n[0] != n[1])
                ids.append(np.full(len(unlike), k))
                codes.append(met[unlike])
                counts.append(n[:, unlike])
            at = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
            n = np.concatenate(counts, axis=1) if counts else np.zeros((2, 0), dtype=np.int64)
            names = pa.array([f"U+{c:04X}" for x in codes for c in x.tolist()], pa.string())
            change = pa.array(np.where(n[1] > n[0], "gained", "lost").tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), names, pa.array(n[0]), pa.array(n[1]), change], names=[id_col, "codepoint", "left_n", "right_n", "change"])

    rows = pairs.select(id_col, F.coalesce(left, F.lit("")).alias("_left"), F.coalesce(right, F.lit("")).alias("_right"))
    kind = rows.schema[id_col].dataType.simpleString()
    return mapped(rows, run, f"`{id_col}` {kind}, codepoint string, left_n long, right_n long, change string")


def bits_per_character(text: str) -> float:
    """Shannon entropy of a text's code points; 0 of an empty text."""
    import numpy as np

    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1].astype(np.float64)
    total = counts.sum()
    return float(np.log2(total) - (counts * np.log2(counts)).sum() / total)


def with_entropy(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """docs with the entropy of text columns, by the new columns' names. Row by row in one Arrow pass: rows of one id stay apart, nothing is shuffled."""
    at = [docs.columns.index(c) for c in columns.values()]
    schema = docs.withColumns({n: F.lit(0.0) for n in columns}).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [pa.array([bits_per_character(t) for t in batch.column(k).to_pylist()], pa.float64()) for k in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.names)

    return mapped(docs, run, schema)


def entropy(docs: DataFrame, column: str = "marked", id_col: str = "doc_id") -> DataFrame:
    """doc_id, entropy: Shannon bits per code point; empty texts have 0."""
    return with_entropy(docs.select(id_col, column), {"entropy": column}).select(id_col, "entropy")


def entropy_class(entropy_col="entropy"):
    e = F.col(entropy_col)
    return F.when(e < 2, "very_low").when(e < 4, "normal").when(e < 5, "slightly_elevated").when(e < 6.5, "elevated").otherwise("very_high")
