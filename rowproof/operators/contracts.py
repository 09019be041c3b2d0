"""Contracts over aggregates: a declared relation between two grouped values, evaluated group by group.

    paid = Agg("sum", "amount").of(payments).by("order_id")
    due = Agg("sum", F.col("price") * F.col("quantity")).of(lines).where(F.col("status").isin("open", "sent")).by("order_id")
    violations(paid, due, "<=", within=0.01)

A comparison is a DataFrame of the groups with both values and whether the relation holds. A group that one side
lacks is a mismatch; NULL values count as 0; `within` is an absolute, `relative` a relative tolerance (a share of
the right side's magnitude, group by group, or of that of another aggregate by the same keys, `relative_to`). What is aggregated, and the rows, are any Spark expressions; numbers are
summed as they are, or exactly in a number of decimals where `scale` names one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions import column, scaled
from rowproof.operators import facts


@dataclass(frozen=True, eq=False)
class Agg:
    """A grouped aggregate of a frame, perhaps joined with another first."""

    function: str
    column: str | Column
    frame: DataFrame | None = None
    keys: tuple[str, ...] = ()
    scale: int | None = None

    def of(self, frame: DataFrame) -> Agg:
        return replace(self, frame=frame)

    def by(self, *keys: str) -> Agg:
        return replace(self, keys=keys)

    def where(self, condition: Column | str) -> Agg:
        return replace(self, frame=self.frame.where(condition))

    def joined_on(self, other: DataFrame, key: str) -> Agg:
        return replace(self, frame=self.frame.join(other, key))

    def value(self) -> DataFrame:
        c = column(self.column)
        exact = scaled(c, self.scale)
        value = {"sum": F.sum(exact), "avg": F.avg(exact), "min": F.min(c), "max": F.max(c), "count": F.count(c), "count_distinct": F.count_distinct(c)}[self.function]
        return self.frame.groupBy(*self.keys).agg(value.cast("double").alias("value"))


def grain(frame: DataFrame, *keys: str) -> DataFrame:
    """Key values that break the claim of one row per keys (NULL is a value here)."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def refers(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows that refer to no parent row."""
    return facts.orphans(child, parent, key, parent_key)


def rows_that_break(frame: DataFrame, claim: Column) -> DataFrame:
    """Rows for which a claim about their columns is false; where it is NULL, nothing is claimed."""
    return frame.where(~F.coalesce(claim, F.lit(True)))


def compare(left: Agg, right: Agg, relation: str = "=", within: float = 0.0, relative: float = 0.0, relative_to: Agg | None = None) -> DataFrame:
    """(keys, left_value, right_value, holds) for every group of either side. A group that `relative_to` lacks has no
    relative tolerance."""
    names = left.keys
    a = left.value().select(*(F.col(k).alias(n) for k, n in zip(left.keys, names, strict=True)), F.coalesce("value", F.lit(0.0)).alias("left_value"))
    b = right.value().select(*(F.col(k).alias(n) for k, n in zip(right.keys, names, strict=True)), F.coalesce("value", F.lit(0.0)).alias("right_value"))
    if names:
        on = [a[n].eqNullSafe(b[n]) for n in names]
        both = F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
        joined = a.join(b, on, "full").withColumn("__both", both).select(*(F.coalesce(a[n], b[n]).alias(n) for n in names), *(F.coalesce(v, F.lit(0.0)).alias(v) for v in ("left_value", "right_value")), "__both")
    else:
        joined = a.join(F.broadcast(b)).withColumn("__both", F.lit(True))  # one row each
    l, r = F.col("left_value"), F.col("right_value")
    scale = F.abs(r)
    if relative_to is not None:
        base = relative_to.value().select(*(F.col(k).alias(f"base_{i}") for i, k in enumerate(relative_to.keys)), F.col("value").alias("base_value"))
        joined = joined.join(base, [joined[n].eqNullSafe(base[f"base_{i}"]) for i, n in enumerate(names)], "left") if names else joined.join(F.broadcast(base))  # one row
        joined = joined.drop(*(f"base_{i}" for i in range(len(names))))
        scale = F.coalesce(F.abs("base_value"), F.lit(0.0))
    slack = F.lit(within) + F.lit(relative) * scale
    holds: Column = {"=": F.abs(l - r) <= slack, "<>": F.abs(l - r) > slack, "<=": l <= r + slack, "<": l < r + slack, ">=": l >= r - slack, ">": l > r - slack}[relation]
    return joined.withColumn("holds", F.col("__both") & F.coalesce(holds, F.lit(False))).drop("__both", "base_value")


def violations(left: Agg, right: Agg, relation: str = "=", within: float = 0.0, relative: float = 0.0, relative_to: Agg | None = None) -> DataFrame:
    """The groups in which the relation does not hold."""
    return compare(left, right, relation, within, relative, relative_to).where("not holds").drop("holds")
