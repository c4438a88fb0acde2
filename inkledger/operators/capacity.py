"""What a cover can hold: positions, frames, envelopes, missions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from .regions import opened, slots

# Bytes of a light frame's header, and of the envelope around a secret without its length.
HEADER, SALTED_HEADER, ENVELOPE = 8, 24, 13


def carrier_positions(slots: Column, letters: Column) -> Column:
    """(carrier, positions) of the four carriers."""
    whole = F.when(slots < 8, F.lit(0).cast("long")).otherwise(F.floor((slots + 1) / 9) * 8)
    by = {"zero_width": slots, "whitespace_var": whole, "bidi": whole, "homoglyph": letters}
    return F.array(*[F.struct(F.lit(c).alias("carrier"), p.cast("long").alias("positions")) for c, p in by.items()])


def envelope_bytes(secret: Column) -> Column:
    """Bytes of the envelope of a plain secret of so many bytes: its length is written in 7-bit groups."""
    n = secret + 4
    return secret + ENVELOPE + F.when(n < 128, 1).when(n < 16384, 2).otherwise(3)


def capacities(docs: DataFrame, column: str = "cover") -> DataFrame:
    """doc_id, carrier, positions, raw_bytes, framed_bytes, secret_bytes, overhead_bytes: one row per document and carrier.

    Positions in protected regions are none.
    """
    open_ = opened(docs.select("doc_id", F.col(column).alias("cover")), "cover")
    rows = open_.select("doc_id", slots(F.col("open")).alias("slots"), tx.count_of(F.col("open"), cs.LATIN_LOOKALIKES).alias("letters"))
    rows = rows.select("doc_id", F.inline(carrier_positions(F.col("slots"), F.col("letters"))))
    raw = F.floor(F.col("positions") / 8)
    rows = rows.withColumn("raw_bytes", raw).withColumn("framed_bytes", F.greatest(raw - HEADER, F.lit(0)))
    # The inverse of envelope_bytes: the largest secret under each length of the length.
    f = F.col("framed_bytes") - ENVELOPE
    secret = F.greatest(F.least(f - 1, F.lit(123)), F.least(f - 2, F.lit(16379)), f - 3, F.lit(0))
    return rows.withColumn("secret_bytes", secret.cast("long")).withColumn("overhead_bytes", (F.col("framed_bytes") - F.col("secret_bytes")).cast("long"))


def recommended(rows: DataFrame, secret: int) -> DataFrame:
    """doc_id, carrier, mission, density, fits, shortfall_bytes: the strictest mission that holds a secret, with the most margin.

    Ranks are counted within a document: four carriers.
    """
    need = envelope_bytes(F.lit(secret))
    budget = lambda ceiling: F.floor(F.col("positions") * ceiling / 8)
    rank = F.lit(len(cs.MISSIONS))
    for k, (_, ceiling) in reversed(list(enumerate(cs.MISSIONS))):
        rank = F.when((need <= F.col("framed_bytes")) & (need <= budget(ceiling)), F.lit(k)).otherwise(rank)
    fill = F.when(F.col("positions") == 0, F.lit(1.0)).otherwise(need * 8 / F.col("positions"))
    rows = rows.withColumn("mission_rank", rank).withColumn("fill", fill).withColumn("hold", F.least(F.col("framed_bytes"), budget(cs.MISSIONS[-1][1])))
    own = Window.partitionBy("doc_id")
    best = rows.withColumn("best_hold", F.max("hold").over(own)).withColumn("place", F.row_number().over(own.orderBy("mission_rank", "fill", "carrier"))).where("place = 1")
    fits = F.col("mission_rank") < len(cs.MISSIONS)
    names, ceilings = F.array(*[F.lit(m) for m, _ in cs.MISSIONS]), F.array(*[F.lit(c) for _, c in cs.MISSIONS])
    return best.select(
        "doc_id", F.when(fits, F.col("carrier")).alias("carrier"), F.when(fits, F.get(names, "mission_rank")).alias("mission"), F.when(fits, F.get(ceilings, "mission_rank")).alias("density"),
        fits.alias("fits"), F.when(fits, F.lit(0)).otherwise(F.greatest(need - F.col("best_hold"), F.lit(0))).cast("long").alias("shortfall_bytes"),
    )
