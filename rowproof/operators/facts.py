"""Declared facts, verified: each function returns the groups or rows that break the fact (none: it holds).

Groupings count before they shuffle and joins are left to Catalyst, so a hot key is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions import none_of, surrogate_key


def key_violations(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Key values on more than one row (rows with a NULL in the key are no duplicates; `where` limits the claim)."""
    df = df if where is None else df.where(where)
    return df.where(none_of(*keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls) for each column that should have none and has some."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns))
    return counts.select(F.inline(pairs)).where("nulls > 0")


def fd_violations(df: DataFrame, determinant: list[str], dependent: str) -> DataFrame:
    """Determinant values with more than one dependent value (NULL counts as a value); no determinant: a constant."""
    values = F.count_distinct(dependent) + F.max(F.when(F.col(dependent).isNull(), 1).otherwise(0))
    return df.groupBy(*determinant).agg(values.alias("n_values")).where("n_values > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a key that no parent row has (NULL keys refer to nothing and pass)."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def rejected_values(df: DataFrame, column: str, accepted: list) -> DataFrame:
    """(column, n): values outside the accepted ones."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(accepted)).groupBy(column).agg(F.count("*").alias("n"))


def surrogate_violations(df: DataFrame, inputs: list[str], escaped: bool = False) -> DataFrame:
    """(surrogate, n, n_inputs): surrogate keys on more than one row.

    With n_inputs = 1 the inputs are no key either; more mean that different inputs share a surrogate.
    """
    each = df.groupBy(*inputs).agg(F.count("*").alias("c")).withColumn("surrogate", surrogate_key(*inputs, escaped=escaped))
    return each.groupBy("surrogate").agg(F.sum("c").alias("n"), F.count("*").alias("n_inputs")).where("n > 1")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order: the row_number() = 1 idiom, whose result has the key."""
    from pyspark.sql.window import Window

    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def hidden_group_keys(df: DataFrame, keys: dict[str, Column], shown: list[str]) -> DataFrame:
    """(shown, n_groups): rows of a grouped result that look alike, as it shows only some of its group keys.

    keys names what is grouped by; the result of GROUP BY has all of them as a key, and shown alone only if this is
    empty. NULL is a group of its own. Nothing shown: all groups look alike.
    """
    groups = df.select(*(c.alias(name) for name, c in keys.items())).distinct()
    return groups.groupBy(*shown).agg(F.count("*").alias("n_groups")).where("n_groups > 1")


def counterexamples(df: DataFrame, strong: Column, weak: Column) -> DataFrame:
    """Rows that satisfy the stronger filter and not the weaker one: none if strong implies weak on this data."""
    return df.where(strong).where(~F.coalesce(weak, F.lit(False)))


def fact_summary(claims: dict[str, DataFrame]) -> DataFrame:
    """(claim, broken): how many groups or rows break each claim, one job for all."""
    out = None
    for name, rows in claims.items():
        one = rows.agg(F.count("*").alias("broken")).select(F.lit(name).alias("claim"), "broken")
        out = one if out is None else out.unionByName(one)
    return out
