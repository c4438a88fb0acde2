"""Line dedup by site-relative frequency.

Pages are grouped by host. The share of a host's pages that contain a line tells boilerplate from text: lines over a
ratio are dropped from all pages of that host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

#: A line is boilerplate if more than this share of its host's pages contain it, and at least MIN_PAGES do.
RATIO, MIN_PAGES = 0.1, 5
#: Sets of boilerplate lines of up to so many rows are broadcast; larger ones are joined by salted host.
BROADCAST_ROWS = 50_000
SALTS = 64
NO_HOST = "(none)"


def _key(line):
    """A line's identity: 128 bits of hash, so that lines themselves aren't shuffled."""
    return F.concat(F.hex(F.xxhash64(F.lit(11), line)), F.lit("."), F.hex(F.xxhash64(line)))


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines: the keys of the boilerplate lines of every host that has any.

    A host has at most (lines per page) / ratio such lines on average, however many pages: the sets stay small. Counts
    are summed before the shuffle, and a page counts once for a line. Lines of white space only don't count.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(NO_HOST))
    pages = pages.select(host.alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    counts = pages.select("host", F.explode(lines).alias("line")).select("host", _key(F.col("line")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= min_pages)
    # Both sides have a row per host or per frequent line of a host.
    frequent = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_set("key").alias("lines"))


def without_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with text_col cut to the lines that aren't their host's boilerplate, and with n_lines and n_dropped.

    Lines are what \\n separates and are compared as they are; lines of white space only are always kept. The kept lines
    are joined by \\n in their order; where none is left, the text is empty. Null texts stay null with no line;
    null hosts are one host. Repeated rows are pages of their own. An empty table gives an empty table. Columns
    n_lines and n_dropped of pages give way to the new ones; all other columns stay as they are.

    The boilerplate sets are stored; if they are within BROADCAST_ROWS hosts and lines they are broadcast, else pages are
    joined with them by host and salt, so that no host's pages meet in one task.
    """
    return _cut(pages.drop("n_lines", "n_dropped"), host_col, text_col, ratio, min_pages).select("page.*", "n_lines", "n_dropped")


def cleaned(pages: DataFrame, size_col: str | None = "n_chars", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with text_col cut, and size_col, if they have it, that of the text left where lines were dropped; all other columns as they came."""
    rows = _cut(pages, host_col, text_col, ratio, min_pages)
    if size_col in pages.columns:
        kind = pages.schema[size_col].dataType
        size = F.when(F.col("n_dropped") > 0, F.length(f"page.{text_col}").cast(kind)).otherwise(F.col("page")[size_col])
        rows = rows.withColumn("page", F.col("page").withField(size_col, size))
    return rows.select("page.*")


def _cut(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """page (a row as it came, but for its text), n_lines, n_dropped."""
    spark = pages.sparkSession
    found = stored(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    size = found.select(F.coalesce(F.sum(F.size("lines") + 1), F.lit(0)).alias("n")).first()["n"]
    # The row as it came is one column, so that no name in it can meet one of ours.
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(NO_HOST))
    rows = pages.select(F.struct("*").alias("page"), host.alias("host"), F.col(text_col).alias("text"))
    found = found.withColumnRenamed("host", "of")
    if size <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(found), F.col("host") == F.col("of"), "left")
    else:
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(partitions(spark), "of", "salt")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("text", "host"), F.lit(SALTS)).cast("int"))
        rows = rows.join(found, (F.col("host") == F.col("of")) & (F.col("own") == F.col("salt")), "left")
    split = F.split("text", "\n")
    stays = lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("lines"), _key(x))
    rows = rows.withColumn("rest", F.when(F.col("lines").isNull(), split).otherwise(F.filter(split, stays)))
    count = lambda x: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(x)).cast("long")
    kept = F.col("page").withField(text_col, F.array_join("rest", "\n"))
    return rows.select(kept.alias("page"), count(split).alias("n_lines"), (count(split) - count(F.col("rest"))).alias("n_dropped"))


def sql(source: str = "documents", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """CTEs of the same computation in DuckDB's SQL, ending in `lined`: the columns of documents, n_lines, n_dropped."""
    return f"""ln_p AS (SELECT row_number() OVER () AS rid, *, coalesce(CAST(source AS VARCHAR), '{NO_HOST}') AS host FROM {source}),
ln_x AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ln_p WHERE text IS NOT NULL),
ln_t AS (SELECT host, count(*) AS pages FROM ln_p GROUP BY host),
ln_n AS (SELECT host, line, count(DISTINCT rid) AS n FROM ln_x WHERE trim(line) <> '' GROUP BY host, line),
ln_b AS (SELECT host, line FROM ln_n JOIN ln_t USING (host) WHERE n >= {min_pages} AND n > CAST({ratio} AS DOUBLE) * pages),
ln_k AS (SELECT x.rid, string_agg(x.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL) AS kept, count(*) AS n_lines, count(b.line) AS n_dropped FROM ln_x x LEFT JOIN ln_b b ON x.host = b.host AND x.line = b.line GROUP BY x.rid),
lined AS (SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, p.lang, p.source, p.n_chars, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped FROM ln_p p LEFT JOIN ln_k k USING (rid))"""
