"""Aggregates: how each behaves under duplicated rows, and sums that mix units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions import scaled, total


@dataclass(frozen=True)
class Behaviour:
    """combine, select or count the input's magnitude (None: neither); whether repeated rows change the result."""

    magnitude: str | None
    sees_duplicates: bool


#: Behaviour of each aggregate.
REGISTRY = {
    **{name: Behaviour("combine", True) for name in ("sum", "avg", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "kurtosis", "skewness", "median", "mode", "percentile", "percentile_approx", "percentile_cont", "percentile_disc")},
    **{name: Behaviour("select", False) for name in ("min", "max", "min_by", "max_by", "any_value", "first", "last")},
    "count": Behaviour("count", True), "count_if": Behaviour("count", True), "approx_count_distinct": Behaviour("count", False),
    "bool_and": Behaviour(None, False), "bool_or": Behaviour(None, False), "bit_and": Behaviour(None, False), "bit_or": Behaviour(None, False), "bit_xor": Behaviour(None, True),
    "collect_list": Behaviour(None, True), "listagg": Behaviour(None, True),
}


def duplicate_sensitive(name: str, distinct: bool = False) -> bool:
    """Do repeated rows change it? DISTINCT input never does; an unknown aggregate is taken to."""
    return not distinct and REGISTRY.get(name, Behaviour(None, True)).sees_duplicates


#: Rows in a block at most, before rows are repeated.
BLOCK = 10_000


def _values(df: DataFrame, aggregates: dict[str, Column], held: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """One row: each aggregate over all rows; those in `held` by blocks of rows, and then over the blocks."""
    out = df.agg(*(c.cast("double").alias(name) for name, c in aggregates.items()))
    if held:
        pieces = df.groupBy(F.col("__block")).agg(*(piece.alias(name) for name, (piece, _) in held.items()))
        out = out.join(F.broadcast(pieces.agg(*(whole(F.col(name)).cast("double").alias(name) for name, (_, whole) in held.items()))))  # one row
    return out


def duplication_effect(df: DataFrame, aggregates: dict[str, Column], repeat: Column, held: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """(aggregate, base, duplicated): each aggregate over the rows and over the rows with some repeated.

    `repeat` says how often each row occurs; it must differ between rows, as even repetition hides averages. An
    aggregate that keeps every value (a list, a string) would put the table into one task; what is measured of it
    goes into `held`: a column over a block of rows, and a function that puts the blocks' values together.
    """
    held = held or {}
    df = df.withColumn("__block", F.expr(f"monotonically_increasing_id() div {BLOCK}"))
    base = _values(df, aggregates, held)
    more = _values(df.withColumn("__times", F.explode(F.sequence(F.lit(1), repeat.cast("int")))), aggregates, held)
    names = [*aggregates, *held]
    long = lambda x, value: x.select(F.inline(F.array(*(F.struct(F.lit(n).alias("aggregate"), F.col(n).alias(value)) for n in names))))
    return long(base, "base").join(long(more, "duplicated"), "aggregate")


def mixed_units(df: DataFrame, keys: list[str], unit: str, measure: str, scale: int | None = None) -> DataFrame:
    """Groups whose sum adds amounts of more than one unit; a key, pin or dependency on the unit leaves none."""
    x = df.groupBy(*keys).agg(F.count_distinct(unit).alias("units"), total(measure, scale).alias("mixed_total"))
    return x.where("units > 1")


def grain_inflation(df: DataFrame, origin_key: str, measure: str, scale: int | None = None) -> DataFrame:
    """(as_summed, at_origin): a measure summed over a relation that repeats its origin's rows, and once per origin."""
    once = df.groupBy(origin_key).agg(F.max(measure).alias("m"), F.count("*").alias("n"))
    both = F.sum(scaled("m", scale) * F.col("n")).cast("double")
    return once.agg(both.alias("as_summed"), total("m", scale).alias("at_origin"))


def discharged_by_dependency(df: DataFrame, keys: list[str], determinant: str, unit: str) -> DataFrame:
    """(keys, units, determinants): groups that mix units though each value of the determinant has one.

    Where grouping by the determinant is free of them and this is not, the group key is too coarse: the dependency
    determinant -> unit holds and the key does not fix the determinant. Groups whose own rows break the dependency
    are left out.
    """
    x = df.groupBy(*keys, determinant).agg(F.min(unit).alias("low"), F.max(unit).alias("high"))
    x = x.groupBy(*keys).agg(F.count("*").alias("determinants"), F.bool_or(F.col("low") != F.col("high")).alias("broken")).where("not coalesce(broken, false)")
    # distinct units are counted as rows: no group's set of units is held by a task
    n = df.groupBy(*keys).agg(F.count_distinct(unit).alias("units")).where("units > 1")
    on = [n[k].eqNullSafe(x[k]) for k in keys]
    return n.join(x, on).select(*(n[k] for k in keys), "units", "determinants")


def grouping_set_rows(df: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """(keys, level, n): rows of grouping sets; `level` (grouping_id) tells a total's NULL from a NULL in the data."""
    return df.groupingSets(sets, *keys).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


def sketch_error(df: DataFrame, keys: list[str], value: str, within: float = 0.05) -> DataFrame:
    """(keys, exact, close): distinct values counted, and whether a mergeable sketch's estimate is within a share of it."""
    x = df.groupBy(*keys).agg(F.count_distinct(value).alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(value), F.lit(14))).alias("estimate"))
    return x.select(*keys, "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * within).alias("close"))
