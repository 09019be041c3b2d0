"""Connected components by alternating large-star and small-star.

Each step is a minimum per node (pre-aggregated before the shuffle) and a join, so a node with very many
neighbours is no hot group. Each round's edges are written to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    """Number and fingerprint of the edges, to see whether a round changed them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (a, b) of whole numbers: the smallest node that each reaches.

    Nodes that are their component's smallest, or have no edge to another node, are left out. Repeated edges and
    loops are fine; edges with a null end are dropped; no edges give no rows.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
