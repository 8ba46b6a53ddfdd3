"""Connected components of a graph too large for one machine: alternating large and small stars.

Every round each node's neighbours are tied to the smallest of them, first the larger ones, then the smaller ones. All
steps are aggregations and equi-joins of narrow rows, stored between rounds; no node's neighbours are ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import discard, stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) in both directions -> ties to the smallest neighbour, in one direction (v > u)."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = edges.join(least, "u")
    if large:
        return tied.filter("v > u").select(F.col("m").alias("u"), "v").distinct()
    # Small star: u itself and its smaller neighbours.
    below = tied.filter("v < u")
    return below.select("m", "v").union(below.select("m", F.col("u").alias("v"))).filter("v <> m").select(
        F.col("m").alias("u"), "v"
    ).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable type -> (node, label) for every node of an edge; label: the smallest node."""
    tied = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = _mark(tied)
    for _ in range(MAX_ROUNDS):
        before, large = tied, stored(_star(_both(tied), True), "large-star")
        tied = stored(_star(_both(large), False), "small-star")
        discard(before)
        discard(large)
        previous, mark = mark, _mark(tied)
        if mark == previous:
            nodes = tied.select(F.col("v").alias("node"), F.col("u").alias("label"))
            roots = tied.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
            return nodes.union(roots)
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
