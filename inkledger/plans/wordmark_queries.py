"""Queries of word-choice statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import wordmark as wm
from ..sources.tables import read, spread
from .query import query


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def with_synonyms(docs: DataFrame) -> DataFrame:
    """Each document followed by words of the lexicon, as many as its id says."""
    lexicon = F.array(*[F.lit(w) for w in wm.WORDS])
    words = F.transform(F.sequence(F.lit(0), (9 + F.col("doc_id") % 30).cast("int")), lambda i: F.get(lexicon, ((F.col("doc_id") * 7 + i) % 40).cast("int")))
    return docs.select("doc_id", F.concat("text", F.lit("\n"), F.array_join(words, " "), F.lit(".")).alias("text"))


_LEXICON = "[" + ", ".join(f"'{w}'" for w in wm.WORDS) + "]"
PLAIN_SQL = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
SYNONYM_SQL = f"{PLAIN_SQL}, words AS (SELECT doc_id, text || chr(10) || array_to_string([{_LEXICON}[(doc_id * 7 + i) % 40 + 1] for i in range(0, 10 + doc_id % 30)], ' ') || '.' AS text FROM docs)"
TOKENS_SQL = f"{PLAIN_SQL}, tokens AS (SELECT doc_id, [substr(sha256(w), 1, 8) for w in regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')] AS t FROM docs)"


@query(f"WITH {TOKENS_SQL} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, '')) AS tokens_md5 FROM tokens")
def wordmark_tokens(spark, sf_dir):
    rows = plain(spark, sf_dir).select("doc_id", wm.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "")).alias("tokens_md5"))


def _sweep_sql() -> str:
    each = []
    for name, seed, gamma, h in wm.CONFIGS:
        head = wm.config_key(seed, name) + "01" + f"{h:08x}"
        drawn = f"substr(sha256(from_hex('{head}' || array_to_string(t[i - {h}:i], ''))), 1, 16)"
        each.append(f"SELECT doc_id, '{name}' AS config, {gamma}::DOUBLE AS gamma, CAST(greatest(len(t) - {h}, 0) AS BIGINT) AS n, CAST(len([1 for i in range({h + 1}, len(t) + 1) if {drawn} < '{wm.THRESHOLDS[gamma]}']) AS BIGINT) AS green FROM tokens")
    return f"{TOKENS_SQL}, counted AS ({' UNION ALL '.join(each)}), sweep AS (SELECT doc_id, config, n, green, CASE WHEN n > 0 THEN (green - gamma * n) / sqrt(n * gamma * (1 - gamma)) ELSE 0.0 END AS z FROM counted)"


@query(f"WITH {_sweep_sql()} SELECT doc_id, config, n, green, round(z, 6) AS z FROM sweep")
def wordmark_sweep(spark, sf_dir):
    return wm.scores(plain(spark, sf_dir)).withColumn("z", tx.rounded(F.col("z")))


@query(f"WITH {_sweep_sql()} SELECT doc_id, round(max(z), 6) AS best_z, CASE WHEN max(z) >= {wm.TAU} THEN arg_max(config, z) END AS hit FROM sweep GROUP BY doc_id")
def wordmark_best_hit(spark, sf_dir):
    best = wm.scores(plain(spark, sf_dir)).groupBy("doc_id").agg(F.max("z").alias("z"), F.max_by("config", "z").alias("config"))
    return best.select("doc_id", tx.rounded(F.col("z")).alias("best_z"), F.when(F.col("z") >= wm.TAU, F.col("config")).alias("hit"))


_RUNS = "regexp_extract_all(lower(text), '\\p{L}+')"


@query(f"WITH {SYNONYM_SQL}, x AS (SELECT doc_id, unnest({_RUNS}) AS w, generate_subscripts({_RUNS}, 1) AS i FROM words) SELECT doc_id, CAST(i - 1 AS INTEGER) AS word_index, CAST((list_position({_LEXICON}, w) - 1) // 2 AS INTEGER) AS synonym_group, CAST((list_position({_LEXICON}, w) - 1) % 2 AS INTEGER) AS variant FROM x WHERE list_contains({_LEXICON}, w)")
def synonym_positions(spark, sf_dir):
    return wm.positions(with_synonyms(plain(spark, sf_dir)), spark)


@query(f"WITH {SYNONYM_SQL}, c AS (SELECT doc_id, array_to_string([(list_position({_LEXICON}, w) - 1) % 2 for w in {_RUNS} if list_contains({_LEXICON}, w)], '') AS channel FROM words) SELECT doc_id, channel, CAST(length(channel) AS INTEGER) AS n FROM c")
def lexical_channel(spark, sf_dir):
    rows = with_synonyms(plain(spark, sf_dir)).select("doc_id", F.array_join(wm.channel(F.col("text")).cast("array<string>"), "").alias("channel"))
    return rows.withColumn("n", F.length("channel"))


_FIRST = "lower(array_to_string([substr(w, 1, 1) for w in regexp_extract_all(text, '\\p{L}+')], ''))"
_LINES = "lower(array_to_string([regexp_extract(s, '\\p{L}') for s in string_split(text, chr(10))], ''))"


@query(f"WITH {PLAIN_SQL} SELECT doc_id, md5({_FIRST}) AS words_md5, {_LINES} AS lines, contains({_FIRST}, 'tat') OR contains({_LINES}, 'tat') AS holds_target FROM docs")
def acrostics(spark, sf_dir):
    words, lines = wm.word_acrostic(F.col("text")), wm.line_acrostic(F.col("text"))
    return plain(spark, sf_dir).select("doc_id", F.md5(words).alias("words_md5"), lines.alias("lines"), (F.contains(words, F.lit("tat")) | F.contains(lines, F.lit("tat"))).alias("holds_target"))


@query(f"WITH {SYNONYM_SQL}, f AS (SELECT doc_id, contains({_FIRST}, 'tat') OR contains({_LINES}, 'tat') AS acrostic, len([1 for w in {_RUNS} if list_contains({_LEXICON}, w)]) AS n FROM words) SELECT doc_id, array_to_string([x for x in [CASE WHEN acrostic THEN 'certain:acrostic' END, CASE WHEN n > 0 THEN 'indication:synonym_channel' END, 'impossible:secret_key'] if x IS NOT NULL], ',') AS findings, CAST(n AS INTEGER) AS positions FROM f")
def wordmark_analyze(spark, sf_dir):
    rows = with_synonyms(plain(spark, sf_dir))
    t = F.col("text")
    n = F.size(wm.channel(t))
    target = F.contains(wm.word_acrostic(t), F.lit("tat")) | F.contains(wm.line_acrostic(t), F.lit("tat"))
    found = F.concat_ws(",", F.when(target, "certain:acrostic"), F.when(n > 0, "indication:synonym_channel"), F.lit("impossible:secret_key"))
    return rows.select("doc_id", found.alias("findings"), n.alias("positions"))


@query(f"WITH {SYNONYM_SQL}, c AS (SELECT doc_id, CAST(len([1 for w in {_RUNS} if list_contains({_LEXICON}, w)]) AS BIGINT) AS total FROM words) SELECT doc_id, total, (total + 2) // 3 AS changed_light, (total + 1) // 2 AS changed_medium, total AS changed_heavy, TRUE AS canonical_kept, total >= 16 AS signed, total >= 16 AS found, FALSE AS found_by_other_key FROM c")
def wordmark_scrub(spark, sf_dir):
    return wm.scrub_report(with_synonyms(plain(spark, sf_dir)), "text", b"k" * 32)


_LP = "[-(CAST((doc_id * {m} + i * i) % 17 AS DOUBLE) + 1) / 10 for i in range(1, 21)]"


@query(f"WITH l AS (SELECT doc_id, {_LP.format(m=3)} AS observer, {_LP.format(m=5)} AS performer FROM documents), p AS (SELECT doc_id, exp(-list_sum(observer) / 20) AS o, exp(-list_sum(performer) / 20) AS f FROM l) SELECT doc_id, round(o, 6) AS perplexity, CASE WHEN f > 0 THEN round(o / f, 6) END AS ratio FROM p")
def perplexity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    logs = lambda m: F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: -(((F.col("doc_id") * m + i * i) % 17).cast("double") + 1) / 10)
    mean = lambda a: F.exp(-F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))
    rows = docs.select("doc_id", mean(logs(3)).alias("o"), mean(logs(5)).alias("f"))
    return rows.select("doc_id", tx.rounded(F.col("o")).alias("perplexity"), F.when(F.col("f") > 0, tx.rounded(F.col("o") / F.col("f"))).alias("ratio"))


_REFUSED = " OR ".join(f"contains(lower(o), '{p.replace(chr(39), chr(39) * 2)}')" for p in wm.REFUSALS)


@query(f"""WITH {PLAIN_SQL}, r AS (SELECT doc_id, text, trim(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN 'I cannot assist with that. ' || text WHEN 3 THEN text || text || text ELSE substr(text, 1, 5) END) AS o FROM docs)
SELECT doc_id, CASE WHEN o = '' THEN 'empty' WHEN {_REFUSED} THEN 'refusal' WHEN length(o) > length(text) * 1.5 + 40 THEN 'bloat' WHEN length(text) > 0 AND length(o) < length(text) * 0.3 THEN 'collapse' END AS refusal FROM r""")
def rewrite_validation(spark, sf_dir):
    t = F.col("text")
    k = F.col("doc_id") % 5
    output = F.when(k == 0, t).when(k == 1, "").when(k == 2, F.concat(F.lit("I cannot assist with that. "), t)).when(k == 3, F.concat(t, t, t)).otherwise(F.substring(t, 1, 5))
    return plain(spark, sf_dir).select("doc_id", wm.rewrite_refusal(t, output).alias("refusal"))
