"""Lineage edges and model graphs as data frames (to_node, from_node)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.sources.shared import shared_folder


def kept(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def closure(edges: DataFrame, to_col: str = "to_node", from_col: str = "from_node") -> DataFrame:
    """(node, ancestor): everything each node derives from. Each round joins only the paths that the last one found."""
    new = paths = kept(edges.select(F.col(to_col).alias("node"), F.col(from_col).alias("ancestor")).distinct())
    while not new.isEmpty():
        after = new.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", F.col("b.ancestor").alias("ancestor"))
        before = paths.alias("a").join(new.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", F.col("b.ancestor").alias("ancestor"))
        new = kept(after.unionByName(before).distinct().join(paths, ["node", "ancestor"], "left_anti"))
        paths = kept(paths.unionByName(new))
    return paths


def base_columns(edges: DataFrame, to_col: str = "to_node", from_col: str = "from_node") -> DataFrame:
    """(node, base): the sources without an edge of their own that each node's values come from.

    Only bases are carried upwards, not all pairs of nodes; each round's pairs are kept once and never rewritten. Nodes
    that derive from cycles alone have no base.
    """
    e = kept(edges.select(F.col(to_col).alias("node"), F.col(from_col).alias("below")).distinct())
    new = kept(e.join(e.select(F.col("node").alias("below")), "below", "left_anti").select("node", F.col("below").alias("base")))
    rounds = [new]
    while not new.isEmpty():
        up = e.alias("e").join(new.alias("n"), F.col("e.below") == F.col("n.node")).select("e.node", "n.base").distinct()
        for found in rounds:
            up = up.join(found, ["node", "base"], "left_anti")
        new = kept(up)
        rounds.append(new)
    return reduce(DataFrame.unionByName, rounds)


def cycles(edges: DataFrame, to_col: str = "to_node", from_col: str = "from_node") -> DataFrame:
    """Nodes that derive from themselves."""
    return closure(edges, to_col, from_col).where("node = ancestor").select("node")


def levels(edges: DataFrame, to_col: str = "to_node", from_col: str = "from_node") -> DataFrame:
    """(node, level): 0 for sources, else one more than the highest level below. On a cycle it ends with an error: a
    level cannot exceed the number of nodes; cycles() names the nodes."""
    e = edges.select(F.col(to_col).alias("t"), F.col(from_col).alias("f")).distinct()
    at = kept(e.select(F.col("f").alias("node")).unionByName(e.select(F.col("t").alias("node"))).distinct().withColumn("level", F.lit(0)))
    n = at.count()
    for _ in range(n + 1):
        up = e.join(at, F.col("f") == F.col("node")).groupBy(F.col("t").alias("node")).agg((F.max("level") + 1).alias("up"))
        new = kept(at.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if new.join(at.withColumnRenamed("level", "was"), "node").where("level <> was").isEmpty():
            return new
        at = new
    raise ValueError("the graph has a cycle: cycles() names its nodes")
