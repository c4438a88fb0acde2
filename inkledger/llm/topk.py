"""Exact top-k search by term-at-a-time accumulation.

A vector is a sparse row of integer weights by dimension. For a block of candidates each dimension has a posting
list. A query row is scored one term at a time: the term's weighted postings are scattered into a dense
array of scores, then the largest are selected by partition, and the blocks' selections are merged.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SCHEMA = "query_id long, query_key long, vec_id long, score long, beyond binary"
#: Rows of a block if they have so many dimensions; fewer of longer ones. A block is 16 MB of candidates and 4 MB of queries, and
#: N candidates and Q queries make N * Q / QUERIES + Q * N / CANDIDATES rows of shuffle.
CANDIDATES, QUERIES, DIMENSIONS = 32_768, 8192, 64
#: Candidates of a block at least, where more blocks would only keep more cores busy.
LEAST_CANDIDATES = 2048
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Scores that fit a long all have this mark; others are ordered by theirs.
FITS = b"\x01"


def beyond(score: int) -> bytes:
    """A mark whose order as bytes is that of scores outside a long; those inside have FITS."""
    if _LOW <= score <= _HIGH:
        return FITS
    size = (abs(score).bit_length() + 7) // 8
    magnitude = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + magnitude if score > 0 else b"\x00" + bytes(255 - x for x in magnitude) + b"\xff"


def terms(vectors, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, floor(scale * x)) of every component that isn't 0 then: 64-bit integers if all fit, else Python's."""
    import pyarrow as pa

    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    values = np.asarray(lists.flatten(), dtype=np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    dimension = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if np.abs(values).max(initial=0.0) < 2.0**62 / scale:
        weights = np.floor(values * scale).astype(np.int64)
    else:
        # A double that large is a whole number.
        weights = np.array([math.floor(x * scale) if abs(x * scale) < 2.0**62 else int(x) * scale for x in values.tolist()], dtype=object)
    some = np.flatnonzero(weights)
    return row[some], dimension[some], weights[some]


class Postings:
    """Posting lists of a block of candidates, for queries of at most so many terms, none larger than `largest`."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, dimension: np.ndarray, weights: np.ndarray, largest: int, most: int):
        order = np.argsort(ids, kind="stable")
        self.ids, place = ids[order], np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        # Sums that could leave 64 bits are taken in Python's integers.
        self.kind = np.int64 if int(abs(weights).max(initial=0)) * largest * most <= _HIGH else object
        row, weights = place[row], weights.astype(self.kind)
        by_term = np.lexsort((row, dimension))
        row, dimension, weights = row[by_term], dimension[by_term], weights[by_term]
        known, starts = np.unique(dimension, return_index=True)
        self.lists = {}
        for term, low, high in zip(known.tolist(), starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True):
            # A full list needs no row numbers: its weights are added as they stand.
            self.lists[term] = (None if high - low == len(ids) else row[low:high], weights[low:high])

    def best(self, query_id: int, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best candidates of a query's terms, and their scores; ties go to smaller ids."""
        scores = np.zeros(len(self.ids), dtype=self.kind)
        for term, weight in query:
            if term in self.lists:
                rows, weights = self.lists[term]
                if rows is None:
                    scores += weights * weight
                else:
                    scores[rows] += weights * weight
        others = np.flatnonzero(self.ids != query_id)
        scores, ids = scores[others], self.ids[others]
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k] if self.kind is np.int64 else sorted(scores.tolist())[-k]
            over, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
            chosen = np.concatenate((over, ties[: k - len(over)]))
        else:
            chosen = np.arange(len(scores))
        return ids[chosen], scores[chosen]


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and v is not null").where(~bad)


def top_k(vectors: DataFrame, query_modulus: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by query_modulus.

    Every query meets every other row, in blocks of at most about QUERIES by CANDIDATES rows, so the work is that of
    an exhaustive search and a task holds two blocks. Rows with the query's own id are its own and no candidates. Query rows
    of one id and different vectors are queries of their own, each with ranks from 1; equal ones are one query. Null ids and
    vectors that are null or hold null or non-finite components take no part; an empty vector scores 0;
    vectors of unequal length are compared as sparse rows, a missing component being 0. Scores are exact integers of any
    size and ranked as such; one that a long can't hold is given as the nearest long. Ties go to the smaller id, repeated
    candidate rows each take a rank. An empty table, or one without queries, gives no row. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, id_col, vector_col)
    is_query = F.col("vec_id") % query_modulus == 0
    width = F.size("v")
    sizes = rows.select(F.count("*").alias("n"), F.sum(width).alias("all"), F.sum(F.when(is_query, width)).alias("asked")).first()
    blocks = lambda components, rows: -(-(components or 0) // (rows * DIMENSIONS))
    n_queries = max(1, blocks(sizes["asked"], QUERIES))
    n_candidates = max(1, blocks(sizes["all"], CANDIDATES), min(partitions(spark), sizes["n"] // LEAST_CANDIDATES))
    dealt = lambda seed, n: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    block = F.col("candidates").cast("long") * n_queries + F.col("queries")
    candidates = (
        rows.withColumn("candidates", dealt(1, n_candidates)).withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).select(block.alias("block"), "vec_id", "v")
    )
    queries = rows.where(is_query).withColumn("query_key", F.xxhash64("v")).dropDuplicates(["vec_id", "query_key"])
    queries = (
        queries.withColumn("queries", dealt(2, n_queries)).withColumn("candidates", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1)))).select(block.alias("block"), "vec_id", "query_key", "v")
    )
    found = queries.groupBy("block").cogroup(candidates.groupBy("block")).applyInArrow(_searched(k, scale), SCHEMA)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searched(k: int, scale: int):
    def search(queries, candidates):
        import pyarrow as pa

        row, dimension, weights = terms(queries.column("v"), scale)
        ends = np.searchsorted(row, np.arange(queries.num_rows + 1)).tolist()
        asked = list(zip(dimension.tolist(), weights.tolist(), strict=True))
        most = int(np.diff(ends).max(initial=1))
        postings = Postings(np.asarray(candidates.column("vec_id"), dtype=np.int64), *terms(candidates.column("v"), scale), int(abs(weights).max(initial=0)), most)
        columns = {name: [] for name in ("query_id", "query_key", "vec_id", "score", "beyond")}
        for n, (query_id, key) in enumerate(zip(queries.column("vec_id").to_pylist(), queries.column("query_key").to_pylist(), strict=True)):
            ids, scores = postings.best(query_id, asked[ends[n] : ends[n + 1]], k)
            exact = scores.tolist()
            columns["query_id"] += [query_id] * len(ids)
            columns["query_key"] += [key] * len(ids)
            columns["vec_id"] += ids.tolist()
            columns["score"] += [min(max(x, _LOW), _HIGH) for x in exact]
            columns["beyond"] += [beyond(x) for x in exact]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({name: pa.array(c, t) for (name, c), t in zip(columns.items(), kinds, strict=True)})

    return search
