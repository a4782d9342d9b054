"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join; rounds grow with the logarithm of the longest chain, and
every round ends in a written table, so a lost executor costs at most one round. The table of the round
before is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, stash


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _star(sym: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours."""
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u and v (any orderable type, no nulls, loops allowed). Returns (node, root), one
    row per node that occurs in a link between two different nodes; root is the least node reachable.
    An empty table gives an empty result."""
    edges = stash(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u > v in every row of large, so a node's lesser neighbours are the rows that begin with it
        small = _star(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        old, edges = edges, stash(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "links")
        discard(old)
        now = _signature(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
