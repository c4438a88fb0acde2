"""What a worker turns into Python objects at once is bounded, however large its task."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkledger.functions import batches
from inkledger.operators import conceal, pairing


def test_no_portion_is_larger_than_the_bounds(spark):
    rows = spark.range(3000, numPartitions=1).select(F.col("id"), F.repeat(F.lit("x"), 3000).alias("text"))

    def sizes(parts):
        import pyarrow as pa

        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], names=["n", "size"])

    found = batches.mapped(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 3000
    assert max(r["n"] for r in found) <= batches.ROWS
    assert max(r["size"] for r in found) <= batches.MB << 20


def test_operators_read_portions_and_lose_no_row(spark, monkeypatch):
    seen = []
    kept = batches.mapped
    monkeypatch.setattr(conceal, "mapped", lambda *a: seen.append("conceal") or kept(*a))
    monkeypatch.setattr(pairing, "mapped", lambda *a: seen.append("pairing") or kept(*a))
    docs = spark.range(1200, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a few words here").alias("cover"), F.lit("s").alias("secret"))
    marked = conceal.conceal(docs, ("zero_width",))
    found = pairing.measured(marked.select("doc_id", "cover", "marked"))
    assert found.select("doc_id").distinct().count() == 1200
    assert conceal.reveal(marked).where("found.secret = 's'").count() == 1200
    assert set(seen) == {"conceal", "pairing"}
