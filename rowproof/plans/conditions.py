"""Conditions under which a key holds: the most general conjunctions of column = value on which no key repeats.

Only rows whose key repeats in the whole table can break it anywhere, so only they go into the lattice of conditions:
one aggregate over grouping sets counts the repeated keys of every condition at once. A condition inside one that holds
holds too and says nothing more, so levels are pruned by those below.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _conditions(df: DataFrame, columns: list[str], more: list[str], most: int, *aggregates: Column) -> DataFrame:
    """Aggregates of df by `more` and each set of at most `most` of the columns; `free` has a bit for each column that is
    not in the set (the first column the highest), which tells its NULL from a value's."""
    sets = [[*more, *s] for k in range(most + 1) for s in combinations(columns, k)]
    free = reduce(lambda a, b: a + b, (F.grouping(c).cast("int") * (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)))
    return df.groupingSets(sets, *more, *columns).agg(free.alias("free"), *aggregates)


def counts(df: DataFrame, keys: list[str], columns: list[str], most: int | None = None) -> DataFrame:
    """(columns, free, n_rows, repeated): for each condition that some row meets its rows and how many keys repeat there."""
    most = len(columns) if most is None else most
    known = df.select(*keys, *columns)
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    again = known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    # equal rows are counted before they meet the repeated keys
    rows = known.groupBy(*keys, *columns).agg(F.count("*").alias("n")).join(again, keys)
    broken = _conditions(rows, columns, keys, most, F.sum("n").alias("n")).where("n > 1").groupBy(*columns, "free").agg(F.count("*").alias("repeated"))
    whole = _conditions(df.groupBy(*columns).agg(F.count("*").alias("n")), columns, [], most, F.sum("n").alias("n_rows"))
    on = [whole[c].eqNullSafe(broken[c]) for c in [*columns, "free"]]
    return whole.join(broken, reduce(lambda a, b: a & b, on), "left").select(*(whole[c] for c in [*columns, "free"]), "n_rows", F.coalesce("repeated", F.lit(0)).alias("repeated"))


def holding(df: DataFrame, keys: list[str], columns: list[str], most: int | None = None, least: int = 1) -> DataFrame:
    """(condition, n_rows): the most general conditions with at least `least` rows on which the key holds.

    A condition is written `column=value and column=value`, in the columns' order, NULL as `column is null`; the whole
    table is the empty one. Few conditions with many rows come out of columns with few values.
    """
    x = counts(df, keys, columns, most)
    n = len(columns)
    bit = lambda i: F.lit(1 << (n - 1 - i))
    # what is broken is kept; of what holds, only conditions all of whose parents (one column freed) are broken
    held, broken = x.where("repeated = 0"), x.where("repeated > 0")
    ups = F.array(*(F.when(F.col("free").bitwiseAND(bit(i)) == 0, F.struct(*(F.lit(None).cast(df.schema[c].dataType).alias(c) if j == i else F.col(c) for j, c in enumerate(columns)), (F.col("free") + bit(i)).alias("free"))) for i in range(n)))
    parents = held.select(*(F.col(c).alias(f"own_{c}") for c in [*columns, "free"]), "n_rows", F.explode_outer(F.filter(ups, lambda u: u.isNotNull())).alias("up"))
    on = reduce(lambda a, b: a & b, (F.col(f"up.{c}").eqNullSafe(broken[c]) for c in [*columns, "free"]))
    own = [f"own_{c}" for c in [*columns, "free"]]
    met = parents.join(broken.select(*columns, "free", F.lit(True).alias("broken_up")), on, "left").groupBy(*own, "n_rows").agg(F.bool_and(F.coalesce("broken_up", F.col("up").isNull())).alias("largest"))
    parts = (F.when(F.col("own_free").bitwiseAND(bit(i)) == 0, F.coalesce(F.concat(F.lit(f"{c}="), F.col(f"own_{c}").cast("string")), F.lit(f"{c} is null"))) for i, c in enumerate(columns))
    return met.where(F.col("largest") & (F.col("n_rows") >= least)).select(F.concat_ws(" and ", *parts).alias("condition"), "n_rows")
