"""Connected components of an edge table, by contraction with random priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(v, label) of every vertex of edges (u, v): vertices have equal labels if and only if they are connected.

    In each round every vertex moves to the neighbour, or itself, that comes first in the round's random order, and the
    edges are rewritten to where their ends moved; so paths shrink by a constant factor whatever their ids.
    Each round is stored in the shared folder. Labels are vertices, otherwise arbitrary. Minima are
    taken before the shuffle, and a vertex with many edges is only ever the many side of a join.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    moves: list[DataFrame] = []
    vertices = both(now).select(F.col("u").alias("v")).distinct() if now.isEmpty() else None
    while not now.isEmpty():
        order = lambda c, seed=len(moves): F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("p"), F.col(c).alias("id"))
        first = both(now).groupBy("u").agg(F.min(order("v")).alias("best"))
        move = stored(first.select("u", F.least("best", order("u"))["id"].alias("to")), f"{name}-moves")
        moves.append(move)
        ends = now.join(move.select("u", F.col("to").alias("a")), "u").drop("u")
        ends = ends.join(move.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").drop("v").where("a <> b")
        after = stored(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-edges")
        dropped(now)
        now = after
    if not moves:
        return vertices.select("v", F.col("v").alias("label"))
    follow = lambda so_far, move: so_far.join(move.select(F.col("u").alias("label"), F.col("to").alias("next")), "label", "left").select("v", F.coalesce("next", "label").alias("label"))
    return reduce(follow, moves[1:], moves[0].select(F.col("u").alias("v"), F.col("to").alias("label")))
