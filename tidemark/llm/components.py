"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v) with u > v.  The minima are pre-aggregated and joined back, so that the join can be split
    where one node has very many neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    at = both.join(low, "u")
    if large:
        out = at.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = at.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.  edges: columns u and v, of one
    ordered type, in any direction, repeated or not.  Every round is written to the checkpoint folder; rounds follow until
    nothing changes, of which there are about the logarithm of the longest chain."""
    e = frames.cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        e = frames.cut(_star(_star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or now[0] == 0:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
