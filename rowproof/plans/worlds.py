"""Many worlds in one scan: each row carries the set of worlds that it is in, as bits of a number.

A world is a choice for each axis (a full or a partial load, a flag on or off) and so a condition on rows. Facts are
counted for all worlds by one aggregate over one scan, whether they hold everywhere, nowhere or in some.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a number that may be set.
MOST = 62


def enumerate_worlds(axes: dict[str, dict[str, Column]]) -> dict[str, Column]:
    """Every combination of the axes' choices: its name `axis=choice,...` and the condition of its rows."""
    out = {}
    for choice in product(*(x.items() for x in axes.values())):
        name = ",".join(f"{axis}={value}" for axis, (value, _) in zip(axes, choice, strict=True))
        out[name] = reduce(lambda a, b: a & b, (c for _, c in choice), F.lit(True))
    return out


def membership(worlds: dict[str, Column]) -> Column:
    """The worlds that a row is in: bit i for the i-th. A condition that is NULL leaves the row out."""
    if len(worlds) > MOST:
        raise ValueError(f"{len(worlds)} worlds; at most {MOST} fit a number")
    bits = (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(worlds.values()))
    return reduce(lambda a, b: a + b, bits)


def facts_by_world(df: DataFrame, worlds: dict[str, Column], keys: dict[str, list[str]] | None = None, claims: dict[str, Column] | None = None, dependencies: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """(fact, world, broken): how many groups or rows break each fact in each world, worlds without any included.

    `keys`: columns that are a key (a NULL in them is no duplicate). `claims`: conditions that no row makes false.
    `dependencies`: columns that determine another (NULL is a value). Groups are counted for all worlds at once: a row
    goes once to each key or dependency, not once to each world.
    """
    keys, claims, dependencies = keys or {}, claims or {}, dependencies or {}
    names, n = list(worlds), len(worlds)
    bit = lambda i: F.col("in_worlds").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    text = lambda columns: F.array(*(F.col(c).cast("string") for c in columns))
    sent = [F.struct(F.lit(name).alias("fact"), F.lit("key").alias("kind"), F.when(F.forall(text(c), lambda x: x.isNotNull()), text(c)).alias("k"), F.lit(None).cast("string").alias("v")) for name, c in keys.items()]
    sent += [F.struct(F.lit(name).alias("fact"), F.lit("dependency").alias("kind"), text(c).alias("k"), F.coalesce(F.concat(F.lit("="), F.col(v).cast("string")), F.lit("null")).alias("v")) for name, (c, v) in dependencies.items()]
    # a row that breaks a claim is added up before the shuffle, under the claim's name alone
    sent += [F.struct(F.lit(name).alias("fact"), F.lit("claim").alias("kind"), F.when(F.coalesce(~c, F.lit(False)), F.array().cast("array<string>")).alias("k"), F.lit(None).cast("string").alias("v")) for name, c in claims.items()]
    x = df.withColumn("in_worlds", membership(worlds)).where("in_worlds <> 0")
    spread = [f(F.when(bit(i), F.col("v"))).alias(f"{name}{i}") for i in range(n) for name, f in (("low", F.min), ("high", F.max))] if dependencies else []
    groups = x.select("in_worlds", F.inline(F.array(*sent))).where("k is not null").groupBy("fact", "kind", "k").agg(*(F.count_if(bit(i)).alias(f"n{i}") for i in range(n)), *spread)
    differs = lambda i: F.when(F.col("kind") == "dependency", (F.col(f"low{i}") < F.col(f"high{i}")).cast("long")) if dependencies else F.lit(None)
    broken = [F.when(F.col("kind") == "key", (F.col(f"n{i}") > 1).cast("long")).when(F.col("kind") == "claim", F.col(f"n{i}")).otherwise(differs(i)) for i in range(n)]
    counts = groups.groupBy("fact").agg(*(F.sum(b).alias(f"b{i}") for i, b in enumerate(broken)))
    every = df.sparkSession.createDataFrame([(f,) for f in (*keys, *dependencies, *claims)], "fact string")
    counts = every.join(counts, "fact", "left")
    pairs = F.array(*(F.struct(F.lit(name).alias("world"), F.coalesce(f"b{i}", F.lit(0)).alias("broken")) for i, name in enumerate(names)))
    return counts.select("fact", F.inline(pairs))
