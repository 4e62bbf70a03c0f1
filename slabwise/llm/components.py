"""Connected components of an edge table, by alternating large and small stars.

Every step is a partially aggregated minimum or a join of two written tables, so that a hub with a third of all
edges is summed before the shuffle or split by the adaptive skew join. Edges are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import release, written

def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Links what is larger than u (large) or smaller, with u itself, to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    joined = both.join(least, "u")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(linked.where("u <> v").distinct(), "edges")
    release(least)
    return out


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 32))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs to (node, root) with the smallest node of each component as root; nodes that are roots
    themselves and nodes without links are left out. An empty table gives an empty one. The rounds grow with the
    logarithm of the longest chain."""
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    sign = _sign(edges)
    while sign[0]:
        larger = _star(edges, True)
        smaller = _star(larger, False)
        release(edges, larger)
        edges, last, sign = smaller, sign, _sign(smaller)
        if sign == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
