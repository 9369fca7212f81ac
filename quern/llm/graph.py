"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Every step is joins and minimum aggregations; each round's edges are written to the shared folder. A vertex with very many
neighbours costs rows, not a task: minima are aggregated before the shuffle and written, so that the engine can split a hot vertex in the join with them. Rounds are
logarithmic in the longest path. No step has more edges than the one before, so small tables are written by few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """edges (a > b), at most rows of them. Large: link each larger neighbour of u to the least of u and its neighbours. Small: all others to it."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("__m")).select("u", F.least("u", "__m").alias("m"))
        # Neighbours of u above u: the edges whose smaller end is u.
        low = stored(low, rows=2 * rows)
        return edges.join(low, edges.b == low.u).select(F.col("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    low = stored(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), rows=rows)
    moved = edges.join(low, edges.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60, rows: int | None = None) -> DataFrame:
    """id, root (the least id reachable) for every id that has a link; edges: long columns a, b in any order, repeats allowed, at most rows of them if that is known."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, rows=rows)
    before = _state(e)
    for _ in range(rounds):
        e = stored(_star(_star(e, True, before[0]), False, before[0]), rows=before[0])
        # Done when every vertex has one link and no root has any, i.e. when nothing moves any more.
        now = _state(e)
        if now == before:
            roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
            return roots.union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def _state(e: DataFrame) -> tuple:
    """(number of edges, sum of their hashes)"""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
