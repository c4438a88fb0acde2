"""Queries of frames, pipelines and payload protection. Their SQL twins state the property that must hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec, heavy, sealing
from .forensic_queries import view
from .query import query
from .wordmark_queries import PLAIN_SQL, plain


# Checksums byte by byte in SQL: a table of all bytes from the polynomial, then a fold over the text's bytes.
_CRC_SQL = """t AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for n in range(256)] AS t32,
[list_reduce([n << 8, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c >= 32768 THEN xor((c << 1) & 65535, 4129) ELSE c << 1 END) for n in range(256)] AS t16),
b AS (SELECT doc_id, [CAST(instr('0123456789ABCDEF', p[1]) * 16 + instr('0123456789ABCDEF', p[2]) - 17 AS BIGINT) for p in regexp_extract_all(hex(encode(text)), '..')] AS data FROM docs)"""


@query(f"""WITH {PLAIN_SQL}, {_CRC_SQL} SELECT doc_id, printf('%08x', xor(list_reduce(list_prepend(4294967295, data), lambda c, x: xor(c >> 8, t32[(xor(c, x) & 255) + 1])), 4294967295)) AS crc32_hex,
printf('%04x', list_reduce(list_prepend(65535, data), lambda c, x: xor((c << 8) & 65535, t16[xor(c >> 8, x) + 1]))) AS crc16_hex FROM b, t""")
def checksums(spark, sf_dir):
    """CRC-32 and CRC-16 of every whole text."""
    return codec.checksums(plain(spark, sf_dir))


@query()
def carrier_round_trips(spark, sf_dir):
    """Every document through every carrier and back; refusals are named."""
    return codec.round_trips(view(spark, sf_dir))


@query("SELECT CAST(0 AS BIGINT) AS failures, TRUE AS some_written")
def carrier_round_trip_failures(spark, sf_dir):
    rows = codec.round_trips(view(spark, sf_dir))
    bad = F.count_if(F.col("refusal").isNull() & ~(F.col("ok") & F.col("stripped_ok")))
    return rows.agg(bad.alias("failures"), (F.count_if(F.col("refusal").isNull()) > 0).alias("some_written"))


@query("SELECT unnest(['whitespace_var', 'bidi', 'homoglyph']) AS carrier, CAST(0 AS BIGINT) AS failures, TRUE AS a_tenth_judged")
def excerpt_recovery_failures(spark, sf_dir):
    """Saturated copies with a third cut away, by each carrier that repeats; failures among those whose rest must do, a tenth of all at least."""
    rows = codec.excerpts(view(spark, sf_dir)).groupBy("carrier")
    return rows.agg(F.count_if(F.col("ok") == F.lit(False)).alias("failures"), (10 * F.count("ok") >= F.count("*")).alias("a_tenth_judged"))


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) + 28 AS BIGINT) AS sealed_bytes, TRUE AS ok, TRUE AS other_key_refused FROM documents")
def aes_gcm(spark, sf_dir):
    return sealing.aes_round_trip(plain(spark, sf_dir), bytes(range(32)))


@query("SELECT doc_id, TRUE AS chacha_ok, TRUE AS damage_refused, TRUE AS xor_ok, TRUE AS zlib_ok FROM documents")
def payload_codecs(spark, sf_dir):
    return sealing.payload_round_trips(plain(spark, sf_dir))


@query("SELECT doc_id, TRUE AS valid, FALSE AS altered_valid, FALSE AS other_key_valid FROM documents")
def document_signatures(spark, sf_dir):
    return sealing.signatures(plain(spark, sf_dir), bytes(range(32)))


@query("SELECT CAST(0 AS BIGINT) AS failures, TRUE AS some_written, TRUE AS some_refused")
def recoverable_frame_failures(spark, sf_dir):
    rows = heavy.round_trips(view(spark, sf_dir))
    bad = F.count_if(F.col("refusal").isNull() & ~(F.col("ok") & F.col("tail_found") & F.col("markers_found")))
    return rows.agg(bad.alias("failures"), (F.count_if(F.col("refusal").isNull()) > 0).alias("some_written"), (F.count_if(F.col("refusal") == "too_small") > 0).alias("some_refused"))


@query("SELECT CAST(n AS INTEGER) AS flags, n % 2 = 1 AS stealth, n // 2 % 2 = 1 AS detached, CASE n // 4 % 4 WHEN 0 THEN 'conceal' WHEN 1 THEN 'sign' WHEN 2 THEN 'mark' END AS mission, CASE WHEN n >= 16 THEN 'reserved_flags' WHEN n // 4 % 4 = 3 THEN 'unknown_mission' END AS refusal FROM range(64) t(n)")
def frame_flags(spark, sf_dir):
    n = F.col("id")
    mission = F.shiftright(n, 2) % 4
    return spark.range(64).select(
        n.cast("int").alias("flags"), (n % 2 == 1).alias("stealth"), (F.shiftright(n, 1) % 2 == 1).alias("detached"), F.when(mission == 0, "conceal").when(mission == 1, "sign").when(mission == 2, "mark").alias("mission"),
        F.when(n >= 16, "reserved_flags").when(mission == 3, "unknown_mission").alias("refusal"),
    )


@query("SELECT doc_id, TRUE AS valid, TRUE AS altered_refused, TRUE AS kinds_kept FROM documents")
def signed_claims(spark, sf_dir):
    return sealing.claims(plain(spark, sf_dir), bytes(range(32)))
