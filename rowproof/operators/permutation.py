"""What an aggregate depends on, measured: it is run over the same rows in another order, with some repeated, and with
their parts in another order.

Rows are dealt into blocks of bounded size, each block is made once for each variant, and all aggregates run over all
blocks and variants in one job: built-in aggregates, or grouped-aggregate Pandas functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block about.
BLOCK = 1000
#: Groups of a task about: an aggregate that keeps values holds at most 128 groups in memory and then sorts the rest of
#: its rows, which puts the first row of a group last. A task must stay below that with room for uneven hashes.
GROUPS = 40
VARIANTS = ("given", "reversed", "shuffled", "repeated", "halves", "swapped")


def variants(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """The rows of df by block and variant, sorted within partitions as the variant says; `order` is a whole number that
    orders the rows. Rows with the same number, or none, stay together in the order of their other values, so that no
    variant depends on how rows arrive."""
    n = max(1, -(-df.count() // block))
    h = lambda salt: F.xxhash64(F.lit(salt), F.col(order))
    half = F.pmod(h("half"), F.lit(2))
    pick = lambda name, value, other: F.when(F.col("variant") == name, value).otherwise(other)
    x = df.withColumn("block", F.pmod(h("block"), F.lit(n))).withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    x = x.withColumn("part", pick("halves", half, pick("swapped", 1 - half, F.lit(0))))
    x = x.withColumn("place", pick("reversed", -F.col(order), pick("shuffled", h("place"), F.col(order))))
    times = pick("repeated", 1 + F.pmod(h("times"), F.lit(3)), F.lit(1)).cast("int")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    parts = -(-n * len(VARIANTS) // GROUPS)
    return x.repartition(parts, "block", "variant").sortWithinPartitions("block", "variant", "part", "place", *(c for c in df.columns if c != order))


def dependence(df: DataFrame, order: str, aggregates: dict[str, Column], pandas: dict[str, Column] | None = None, distinct: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """(aggregate, blocks, by_order, by_duplicates, by_parts): in how many blocks an aggregate changes when the rows are
    reversed or shuffled, when some are repeated, and when two parts, each in its order, change places.

    Values are compared as text (its SHA-256, as lists are long), so rounding that depends on the order counts. `pandas` has grouped-aggregate Pandas
    functions, and `distinct` aggregates of DISTINCT values: Spark runs the first apart from its own, and regroups rows for
    the second. Integer columns show what an aggregate does best.
    """
    x = variants(df, order, block)
    text = lambda c, name: c.alias(f"a_{name}")
    names = [*aggregates, *(pandas or {}), *(distinct or {})]
    parts = [x.groupBy("block", "variant").agg(*(text(c, n) for n, c in some.items())) for some in (aggregates, distinct, pandas) if some]
    x = reduce(lambda a, b: a.join(b, ["block", "variant"]), parts)
    x = x.select("block", "variant", F.inline(F.array(*(F.struct(F.lit(n).alias("aggregate"), F.sha2(F.coalesce(F.col(f"a_{n}").cast("string"), F.lit("null")), 256).alias("value")) for n in names))))
    value = lambda v: F.max(F.when(F.col("variant") == v, F.col("value")))
    x = x.groupBy("aggregate", "block").agg(*(value(v).alias(v) for v in VARIANTS))
    differ = lambda *pairs: F.count_if(reduce(lambda a, b: a | b, (F.col(p) != F.col(q) for p, q in pairs)))
    return x.groupBy("aggregate").agg(F.count("*").alias("blocks"), differ(("given", "reversed"), ("given", "shuffled")).alias("by_order"), differ(("given", "repeated")).alias("by_duplicates"), differ(("halves", "swapped")).alias("by_parts"))
