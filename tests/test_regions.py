"""Protected regions: positions, bits and marks leave them alone, in SQL form as in the sequential one."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from inkledger.functions import charsets as cs
from inkledger.operators import canary, capacity, codec, regions

CASES = [
    "a $x$ b", "$$$$x$$ y", "`code` and ``a`b`` x", "```\nfence\n```\nx $a b$ ", "~~~\nopen fence", "\\[x\\] \\(y\\) \\(z", "$ a$ b$", "`a\nb` c", "$a\n\nb$", "  ```x\n```", "x ```y``` z", "$$$ $$$", "~~x~~", "\\", "",
    "one$a$two `b``c` end", "$x$$y$ z", "plain words only, with a stop.",
]


@pytest.fixture(scope="module")
def covers(spark):
    made = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(CASES)], "doc_id long, cover string")
    return made.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("cover"))).cache()


def test_slots_and_letters_are_those_of_the_sequential_form(covers):
    got = {(r.doc_id, r.carrier): r.positions for r in capacity.capacities(covers).collect()}
    for r in covers.collect():
        assert got[r.doc_id, "zero_width"] == len(codec.slots(r.cover))
        assert got[r.doc_id, "homoglyph"] == len(codec.read_bits(r.cover, "homoglyph"))


def test_marks_leave_regions_alone_and_are_read_back(spark, covers):
    recipients = spark.createDataFrame([("r0",), ("r1",)], "recipient_id string")
    copies = canary.extracted(canary.batch(covers, recipients, "salt")).collect()
    assert any(regions.HOLE in regions.opened_text(r.cover) for r in copies)
    back = str.maketrans(cs.CYRILLIC_LOOKALIKES, cs.LATIN_LOOKALIKES)
    for r in copies:
        assert r.marked.translate(back) == r.cover and r.found_hex == r.mark_hex and r.found_bytes == r.size
        assert all(r.marked[low:high] == r.cover[low:high] for low, high, _ in codec.protected(r.cover))


def test_trace_knows_nothing_but_the_mark(spark, covers):
    recipients = spark.createDataFrame([(f"r{k}",) for k in range(4)], "recipient_id string")
    copies = canary.batch(covers.where("doc_id < 10000"), recipients, "salt").cache()
    registry = copies.select("mark_hash", "recipient_id")
    # One copy holds most leaks, and one leak is of a salt that nobody registered.
    leaks = copies.select("recipient_id", "size", "marked").unionByName(*[copies.where("doc_id = 1").select("recipient_id", "size", "marked")] * 1)
    got = canary.traced(leaks, registry).where("size >= 4").collect()
    assert got and all((r.recipient, r.confidence) == (r.recipient_id, 1.0) for r in got)
    strange = canary.batch(covers.where("doc_id < 10000"), recipients, "other").select("recipient_id", "size", "marked")
    lost = canary.traced(strange, registry).where("size >= 4").collect()
    assert lost and all(r.recipient is None and r.confidence <= 0.5 for r in lost)
    clean = canary.traced(covers.where("doc_id < 10000").select(F.col("cover").alias("marked")), registry).collect()
    assert {r.recipient for r in clean} == {None} and {r.confidence for r in clean} == {0.0}
