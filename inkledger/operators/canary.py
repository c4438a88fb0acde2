"""Marked copies for recipients, and the recipient that a leaked copy came from."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from ..functions.batches import mapped
from . import codec
from .regions import may_have_regions, opened


def fingerprint(recipient: Column, salt: Column, size: Column) -> Column:
    """Hex of the first `size` bytes of SHA-256(recipient:salt), extended by SHA-256 of it with a counter."""
    first = F.lower(F.sha2(F.encode(F.concat(recipient, F.lit(":"), salt), "utf-8"), 256))
    little = lambda c: F.lower(F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256) % 256), 2, "0"), F.lit("0000")))
    more = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(size / 32) - 1, F.lit(1))), lambda c: F.sha2(F.unhex(F.concat(first, little(c))), 256))
    longer = F.concat(first, F.array_join(more, ""))
    return F.substring(F.when(size <= 32, first).otherwise(longer), F.lit(1), (2 * size).cast("int"))


def _kinds():
    """By code point: 1 for a Latin look-alike, 2 for a Cyrillic one; and the Cyrillic twin of each Latin one."""
    import numpy as np

    kinds, twins = np.zeros(0x110000, dtype=np.uint8), np.zeros(0x110000, dtype=np.uint32)
    for a, b in zip(cs.LATIN_LOOKALIKES, cs.CYRILLIC_LOOKALIKES, strict=True):
        kinds[ord(a)], kinds[ord(b)], twins[ord(a)] = 1, 2, ord(b)
    return kinds, twins


def _free(codes, text: str, kinds):
    """The kind of each character, 0 in protected regions."""
    found = kinds[codes]
    if may_have_regions(text):
        for low, high, _ in codec.protected(text):
            found[low:high] = 0
    return found


def placed(docs: DataFrame, cover: str, bits_hex: str) -> DataFrame:
    """docs with marked: the cover with the bits in its look-alike letters outside protected regions, from the first on; a 1 is a Cyrillic letter."""
    names = docs.columns
    schema = docs.withColumn("marked", F.lit("")).schema
    at_cover, at_bits = names.index(cover), names.index(bits_hex)

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds, twins = _kinds()
        for batch in batches:
            out = []
            for text, data in zip(batch.column(at_cover).to_pylist(), batch.column(at_bits).to_pylist(), strict=True):
                codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).copy()
                bits = np.unpackbits(np.frombuffer(bytes.fromhex(data or ""), dtype=np.uint8))
                at = np.flatnonzero(_free(codes, text, kinds) == 1)[: len(bits)]
                at = at[bits[: len(at)] == 1]
                codes[at] = twins[codes[at]]
                out.append(codes.tobytes().decode("utf-32-le"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "marked"])

    return mapped(docs, write, schema)


def mark_bytes(docs: DataFrame, cover: str = "cover") -> DataFrame:
    """docs with size: the whole bytes that the cover's look-alike letters outside protected regions hold."""
    return opened(docs, cover).withColumn("size", F.floor(tx.count_of(F.col("open"), cs.LATIN_LOOKALIKES) / 8)).drop("open")


def batch(docs: DataFrame, recipients: DataFrame, salt: str) -> DataFrame:
    """doc_id, cover, size, recipient_id, mark_hex, mark_hash, marked: one copy per document and recipient.

    recipients is a parameter table of a few rows; documents are not shuffled.
    """
    both = mark_bytes(docs.select("doc_id", "cover")).join(F.broadcast(recipients), how="cross")
    rows = both.withColumn("mark_hex", fingerprint(F.col("recipient_id"), F.lit(salt), F.col("size"))).withColumn("mark_hash", F.sha2(F.unhex("mark_hex"), 256))
    return placed(rows, "cover", "mark_hex")


def extracted(leaks: DataFrame, column: str = "marked") -> DataFrame:
    """leaks with found_bytes, found_hex, found_hash and detection, read from the look-alike letters outside protected regions."""
    names, at = leaks.columns, leaks.columns.index(column)
    schema = leaks.withColumns({"found_bytes": F.lit(0), "found_hex": F.lit("")}).schema

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds, _ = _kinds()
        for batch in batches:
            found = []
            for text in batch.column(at).to_pylist():
                marks = _free(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), text, kinds)
                bits = marks[marks > 0] == 2
                # Bits left over at the end are none.
                found.append(np.packbits(bits[: len(bits) // 8 * 8]).tobytes().hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(h) // 2 for h in found], pa.int32()), pa.array(found, pa.string())], names=[*names, "found_bytes", "found_hex"])

    confidence = F.least(F.lit(1.0), tx.share(2.0 * tx.substitutions(F.col(column)), tx.positions(F.col(column))))
    rows = mapped(leaks, read, schema)
    return rows.withColumn("found_hash", F.sha2(F.unhex("found_hex"), 256)).withColumn("detection", confidence)


def traced(leaks: DataFrame, registry: DataFrame, column: str = "marked") -> DataFrame:
    """leaks with recipient and confidence: 1 for a registered mark, 0.5 for a strong unknown one, else the detection.

    registry: mark_hash, recipient_id, of all documents; nothing else is known of a leak. The join is on the hash of the mark
    alone, and texts are left behind before it; leaks without marks are spread over all tasks instead of meeting
    under one key, and a key of many leaks is split by adaptive execution. Of recipients with one mark the first counts.
    """
    first = registry.groupBy("mark_hash").agg(F.min("recipient_id").alias("named"))
    rows = extracted(leaks, column).drop(column)
    seen = F.col("detection") >= 0.01
    rows = rows.withColumn("looked_up", F.when(seen, F.col("found_hash")).otherwise(F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))))
    rows = rows.join(first, F.col("looked_up") == F.col("mark_hash"), "left")
    rows = rows.withColumn("recipient", F.when(seen, F.col("named")))
    confidence = F.when(~seen, 0.0).when(F.col("recipient").isNotNull(), 1.0).when(F.col("detection") > 0.3, 0.5).otherwise(F.col("detection"))
    return rows.withColumn("confidence", confidence).drop("named", "mark_hash", "looked_up")
