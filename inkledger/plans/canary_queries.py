"""Queries of capacity, recommendation, canary marks, tracing, and provenance policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets as cs
from ..functions import text as tx
from ..operators import canary as ca
from ..operators import capacity as cp
from ..operators import provenance as pv
from ..operators.regions import HOLE, REGIONS_SQL
from ..sources.tables import MARKED_SQL, read
from .forensic_queries import sql_count, view
from .query import query

_S = f"translate(open, '{cs.CONTROL}', '')"
_SLOTS = f"(length({_S}) + 1 - length(regexp_replace({_S}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) + len(regexp_extract_all({_S}, '[\\p{{L}}\\p{{N}}_]+')) - {sql_count(_S, HOLE)} - len(regexp_extract_all({_S}, '{HOLE}+')))"
CAPACITY_SQL = f"""{MARKED_SQL}, {REGIONS_SQL}, slotted AS (SELECT doc_id, {_SLOTS} AS slots, {sql_count("open", cs.LATIN_LOOKALIKES)} AS letters FROM opened),
placed AS (SELECT doc_id, unnest(['zero_width', 'whitespace_var', 'bidi', 'homoglyph']) AS carrier, CAST(unnest([slots, CASE WHEN slots < 8 THEN 0 ELSE (slots + 1) // 9 * 8 END, CASE WHEN slots < 8 THEN 0 ELSE (slots + 1) // 9 * 8 END, letters]) AS BIGINT) AS positions FROM slotted),
framed AS (SELECT *, positions // 8 AS raw_bytes, greatest(positions // 8 - {cp.HEADER}, 0) AS framed_bytes FROM placed),
capacities AS (SELECT *, greatest(least(framed_bytes - {cp.ENVELOPE} - 1, 123), least(framed_bytes - {cp.ENVELOPE} - 2, 16379), framed_bytes - {cp.ENVELOPE} - 3, 0) AS secret_bytes FROM framed)"""


@query(f"WITH RECURSIVE {CAPACITY_SQL} SELECT doc_id, carrier, positions, CAST(raw_bytes AS BIGINT) AS raw_bytes, CAST(framed_bytes AS BIGINT) AS framed_bytes, CAST(secret_bytes AS BIGINT) AS secret_bytes, CAST(framed_bytes - secret_bytes AS BIGINT) AS overhead_bytes, CASE WHEN positions = 0 THEN 'no_positions' WHEN framed_bytes = 0 THEN 'frame_does_not_fit' WHEN secret_bytes = 0 THEN 'envelope_does_not_fit' END AS zero_reason FROM capacities")
def capacity(spark, sf_dir):
    rows = cp.capacities(view(spark, sf_dir))
    reason = F.when(F.col("positions") == 0, "no_positions").when(F.col("framed_bytes") == 0, "frame_does_not_fit").when(F.col("secret_bytes") == 0, "envelope_does_not_fit")
    return rows.select("doc_id", "carrier", "positions", F.col("raw_bytes").cast("long").alias("raw_bytes"), F.col("framed_bytes").cast("long").alias("framed_bytes"), "secret_bytes", "overhead_bytes", reason.alias("zero_reason"))


@query(f"WITH RECURSIVE {CAPACITY_SQL} SELECT doc_id, CAST(min(secret_bytes) AS BIGINT) AS stack_bytes, arg_min(carrier, (secret_bytes, carrier)) AS narrowest FROM capacities GROUP BY doc_id")
def stack_capacity(spark, sf_dir):
    rows = cp.capacities(view(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.min("secret_bytes").alias("stack_bytes"), F.min_by("carrier", F.struct("secret_bytes", "carrier")).alias("narrowest"))


_MISSIONS = ", ".join(f"('{m}', {c})" for m, c in cs.MISSIONS)


@query(f"WITH RECURSIVE {CAPACITY_SQL}, missions(mission, ceiling) AS (VALUES {_MISSIONS}) SELECT doc_id, carrier, mission, CAST(floor(secret_bytes * CAST(ceiling AS DOUBLE)) AS BIGINT) AS planned_bytes FROM capacities, missions")
def planning(spark, sf_dir):
    missions = F.array(*[F.struct(F.lit(m).alias("mission"), F.lit(c).alias("ceiling")) for m, c in cs.MISSIONS])
    rows = cp.capacities(view(spark, sf_dir)).select("doc_id", "carrier", "secret_bytes", F.inline(missions))
    return rows.select("doc_id", "carrier", "mission", F.floor(F.col("secret_bytes") * F.col("ceiling")).cast("long").alias("planned_bytes"))


_SECRET, _NEED = 40, 40 + cp.ENVELOPE + 1
_RANK = "CASE " + " ".join(f"WHEN {_NEED} <= framed_bytes AND {_NEED} <= floor(positions * CAST({c} AS DOUBLE) / 8) THEN {k}" for k, (_, c) in enumerate(cs.MISSIONS)) + " ELSE 3 END"


@query(
    f"""WITH RECURSIVE {CAPACITY_SQL}, ranked AS (SELECT *, {_RANK} AS rk, CASE WHEN positions = 0 THEN 1.0 ELSE {_NEED * 8} / positions END AS fill, max(least(framed_bytes, floor(positions * CAST(0.85 AS DOUBLE) / 8))) OVER (PARTITION BY doc_id) AS hold FROM capacities),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rk, fill, carrier) AS place FROM ranked)
SELECT doc_id, CASE WHEN rk < 3 THEN carrier END AS carrier, CASE rk WHEN 0 THEN 'conceal' WHEN 1 THEN 'sign' WHEN 2 THEN 'mark' END AS mission, CAST(CASE rk WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.85 END AS DOUBLE) AS density, rk < 3 AS fits, CAST(CASE WHEN rk < 3 THEN 0 ELSE greatest({_NEED} - hold, 0) END AS BIGINT) AS shortfall_bytes FROM best WHERE place = 1"""
)
def recommend(spark, sf_dir):
    return cp.recommended(cp.capacities(view(spark, sf_dir)), _SECRET)


@query(f"SELECT n AS secret_bytes, CAST(n + {cp.ENVELOPE} + CASE WHEN n + 4 < 128 THEN 1 WHEN n + 4 < 16384 THEN 2 ELSE 3 END AS BIGINT) AS envelope_bytes FROM (SELECT DISTINCT n_chars AS n FROM documents)")
def envelope_size(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").select(F.col("n_chars").alias("secret_bytes")).distinct()
    return sizes.select("secret_bytes", cp.envelope_bytes(F.col("secret_bytes")).cast("long").alias("envelope_bytes"))


SALT, N_RECIPIENTS = "batch-1", 5


def recipients(spark: SparkSession) -> DataFrame:
    return spark.range(N_RECIPIENTS).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("recipient_id"))


_LE = "printf('%02x%02x0000', c % 256, c // 256 % 256)"
_FP = f"""{MARKED_SQL}, {REGIONS_SQL}, sized AS (SELECT doc_id, cover, open, CAST({sql_count("open", cs.LATIN_LOOKALIKES)} AS BIGINT) AS letters FROM opened),
r AS (SELECT 'r' || i AS recipient_id, sha256('r' || i || ':{SALT}') AS h FROM range({N_RECIPIENTS}) t(i)),
marks AS (SELECT doc_id, recipient_id, cover, letters, letters // 8 AS size, substr(CASE WHEN letters // 8 <= 32 THEN h ELSE h || array_to_string([sha256(from_hex(h || {_LE})) for c in range(1, CAST(ceil(letters // 8 / 32.0) AS BIGINT))], '') END, 1, CAST(2 * (letters // 8) AS BIGINT)) AS mark_hex FROM sized, r),
registry AS (SELECT *, sha256(from_hex(mark_hex)) AS mark_hash FROM marks),
ones AS (SELECT *, length(regexp_replace(mark_hex, '[^1248]', '', 'g')) + 2 * length(regexp_replace(mark_hex, '[^3569ac]', '', 'g')) + 3 * length(regexp_replace(mark_hex, '[^7bde]', '', 'g')) + 4 * length(regexp_replace(mark_hex, '[^f]', '', 'g')) AS n FROM registry)"""


@query(f"WITH RECURSIVE {_FP} SELECT doc_id, recipient_id, CAST(size AS BIGINT) AS size, mark_hash FROM registry")
def derive_fingerprints(spark, sf_dir):
    rows = ca.mark_bytes(view(spark, sf_dir).select("doc_id", "cover")).select("doc_id", "size").join(F.broadcast(recipients(spark)), how="cross")
    mark = ca.fingerprint(F.col("recipient_id"), F.lit(SALT), F.col("size"))
    return rows.select("doc_id", "recipient_id", F.col("size").cast("long").alias("size"), F.sha2(F.unhex(mark), 256).alias("mark_hash"))


@query(f"WITH RECURSIVE {_FP} SELECT doc_id, recipient_id, CAST(n AS BIGINT) AS substituted, TRUE AS restores FROM ones")
def mark_batch(spark, sf_dir):
    rows = ca.batch(view(spark, sf_dir).select("doc_id", "cover"), recipients(spark), SALT)
    t = F.col("marked")
    return rows.select("doc_id", "recipient_id", tx.count_of(t, cs.CYRILLIC_LOOKALIKES).alias("substituted"), (F.translate(t, cs.CYRILLIC_LOOKALIKES, cs.LATIN_LOOKALIKES) == F.col("cover")).alias("restores"))


# A leak is the whole copy, its first half (of texts without a marker of regions, which a cut could open), or the cover without a mark.
_LEAK = "CASE WHEN doc_id % 4 = 3 THEN 'unmarked' WHEN doc_id % 4 = 2 AND NOT regexp_matches(cover, '[$`~\\\\]') THEN 'half' ELSE 'whole' END"
_POP = "length(regexp_replace({0}, '[^1248]', '', 'g')) + 2 * length(regexp_replace({0}, '[^3569ac]', '', 'g')) + 3 * length(regexp_replace({0}, '[^7bde]', '', 'g')) + 4 * length(regexp_replace({0}, '[^f]', '', 'g'))"


@query(
    f"""WITH RECURSIVE {_FP}, best AS (SELECT mark_hash, min(recipient_id) AS named FROM registry GROUP BY mark_hash),
leaks AS (SELECT *, {_LEAK} AS leak FROM ones), read AS (SELECT *, CASE WHEN leak = 'half' THEN substr(cover, 1, length(cover) // 2) ELSE cover END AS part FROM leaks),
counted AS (SELECT *, {sql_count("part", cs.LATIN_LOOKALIKES)} AS k, least(CASE WHEN leak = 'half' THEN {sql_count("part", cs.LATIN_LOOKALIKES)} ELSE letters END, size * 8) AS used, CASE WHEN leak = 'half' THEN {sql_count("part", cs.LATIN_LOOKALIKES)} // 8 ELSE size END AS got FROM read),
marked_ AS (SELECT *, CASE WHEN leak = 'unmarked' THEN 0 ELSE {_POP.format("substr(mark_hex, 1, CAST(used // 4 AS BIGINT))")} + CASE WHEN used % 4 = 0 THEN 0 ELSE bit_count((instr('0123456789abcdef', substr(mark_hex, CAST(used // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(4 - used % 4 AS INTEGER)) END END AS subs FROM counted),
seen AS (SELECT *, CASE WHEN k > 0 THEN least(1.0, 2.0 * subs / k) ELSE 0.0 END AS detection, sha256(from_hex(substr(mark_hex, 1, CAST(2 * got AS BIGINT)))) AS found FROM marked_),
looked AS (SELECT s.doc_id, s.recipient_id, leak, detection, CASE WHEN detection >= 0.01 THEN b.named END AS recipient FROM seen s LEFT JOIN best b ON s.found = b.mark_hash)
SELECT doc_id, recipient_id AS true_recipient, leak, recipient, CAST(CASE WHEN detection < 0.01 THEN 0.0 WHEN recipient IS NOT NULL THEN 1.0 WHEN detection > 0.3 THEN 0.5 ELSE detection END AS DOUBLE) AS confidence FROM looked"""
)
def trace_origin(spark, sf_dir):
    """Every copy is leaked, whole, in half or without its marks, and traced against the registry of all documents by its mark alone."""
    docs = view(spark, sf_dir).select("doc_id", "cover")
    sizes = ca.mark_bytes(docs).select("size").distinct().join(F.broadcast(recipients(spark)), how="cross")
    registry = sizes.select("recipient_id", F.sha2(F.unhex(ca.fingerprint(F.col("recipient_id"), F.lit(SALT), F.col("size"))), 256).alias("mark_hash"))
    plain = F.col("doc_id") % 4
    leak = F.when(plain == 3, "unmarked").when((plain == 2) & ~F.col("cover").rlike("[$`~\\\\]"), "half").otherwise("whole")
    text = F.when(F.col("leak") == "unmarked", F.col("cover")).when(F.col("leak") == "half", F.substring("marked", F.lit(1), F.floor(F.length("marked") / 2).cast("int"))).otherwise(F.col("marked"))
    leaks = ca.batch(docs, recipients(spark), SALT).withColumn("leak", leak).select("doc_id", F.col("recipient_id").alias("true_recipient"), "leak", text.alias("marked"))
    return ca.traced(leaks, registry).select("doc_id", "true_recipient", "leak", "recipient", "confidence")


@query(f"WITH RECURSIVE {_FP} SELECT a.doc_id, a.recipient_id AS holder, b.recipient_id AS claimed, a.size > 0 AND a.mark_hex = b.mark_hex AS verified FROM marks a JOIN marks b USING (doc_id)")
def verify_mark(spark, sf_dir):
    copies = ca.extracted(ca.batch(view(spark, sf_dir).select("doc_id", "cover"), recipients(spark), SALT).select("doc_id", F.col("recipient_id").alias("holder"), "marked"))
    rows = copies.join(F.broadcast(recipients(spark)), how="cross")
    expected = ca.fingerprint(F.col("recipient_id"), F.lit(SALT), F.col("found_bytes"))
    n = F.least(F.length("found_hex"), F.length(expected))
    same = F.substring(F.col("found_hex"), F.lit(1), n) == F.substring(expected, F.lit(1), n)
    return rows.select("doc_id", "holder", F.col("recipient_id").alias("claimed"), ((n > 0) & same).alias("verified"))


_CLAIMS = f"""claims AS (SELECT d.doc_id, k AS claim, CASE k WHEN 0 THEN 'human_authorship' WHEN 1 THEN 'integrity' ELSE 'recipient_fingerprint' END AS kind, 's' || ((doc_id + k) % 4) AS signer, (doc_id + k) % 5 <> 0 AS valid,
CASE WHEN (doc_id + 2 * k) % 3 = 0 THEN sha256('other') ELSE sha256(coalesce(text, '')) END = sha256(coalesce(text, '')) AS unaltered, CAST((doc_id * 7 + k) % 3 AS INTEGER) AS robustness FROM documents d, range(3) r(k)),
required(kind, signer) AS (VALUES ('human_authorship', NULL), ('integrity', 's1'), ('ai_generated', NULL)), trusted(signer) AS (VALUES ('s0'), ('s1'), ('s2'))"""


@query(f"WITH {_CLAIMS} SELECT d.doc_id, q.kind, EXISTS (SELECT 1 FROM claims c WHERE c.doc_id = d.doc_id AND c.kind = q.kind AND c.valid AND c.unaltered AND (q.signer IS NULL OR q.signer = c.signer)) AS met FROM documents d, required q")
def policy_requirements(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return pv.requirements(docs, pv.sample_claims(docs), pv.sample_requirements(spark))


@query(f"WITH {_CLAIMS} SELECT doc_id, arg_max(kind, (robustness, -claim)) AS kind, max(robustness) AS robustness FROM claims WHERE valid AND unaltered AND signer IN (SELECT signer FROM trusted) GROUP BY doc_id")
def strongest_claim(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return pv.strongest(pv.sample_claims(docs), spark.createDataFrame([("s0",), ("s1",), ("s2",)], "signer string"))


@query(f"WITH {_CLAIMS} SELECT doc_id, CAST(claim AS INTEGER) AS claim, kind, valid AS signature_valid, signer IN (SELECT signer FROM trusted) AS signer_trusted, unaltered AS document_unaltered, CASE WHEN NOT valid THEN 'signature_invalid' WHEN NOT unaltered THEN 'document_altered' WHEN signer NOT IN (SELECT signer FROM trusted) THEN 'signer_unknown' END AS finding FROM claims")
def verify_claims(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return pv.verified(pv.sample_claims(docs), spark.createDataFrame([("s0",), ("s1",), ("s2",)], "signer string"))


@query("WITH l AS (SELECT doc_id, ['text', 'file', 'all'][CAST(doc_id % 3 + 1 AS BIGINT)] AS module, '2025-0' || (1 + doc_id % 9) || '-01' AS expires, CASE WHEN doc_id % 4 = 0 THEN '*.example.com' ELSE 'www.example.com' END AS domain FROM documents) SELECT doc_id, CASE WHEN module NOT IN ('text', 'all') THEN 'module_not_licensed' WHEN expires < '2025-05-01' THEN 'expired' WHEN NOT (domain = 'api.example.com' OR (starts_with(domain, '*.') AND ends_with('api.example.com', substr(domain, 2)))) THEN 'domain_mismatch' END AS refusal FROM l")
def license_checks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", F.get(F.array(F.lit("text"), F.lit("file"), F.lit("all")), (F.col("doc_id") % 3).cast("int")).alias("module"), F.concat(F.lit("2025-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("-01")).alias("expires"),
        F.when(F.col("doc_id") % 4 == 0, "*.example.com").otherwise("www.example.com").alias("domain"),
    )
    return rows.select("doc_id", pv.license_refusal("text", "2025-05-01", "api.example.com").alias("refusal"))
