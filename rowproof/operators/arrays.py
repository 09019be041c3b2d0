"""Flattening of arrays that may be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dropped_parents(df: DataFrame, array: Column) -> DataFrame:
    """Rows that an inner flatten of the array drops: NULL and empty arrays."""
    return df.where(F.coalesce(F.size(array) <= 0, F.lit(True)))


def flatten_counts(df: DataFrame, array: Column) -> DataFrame:
    """(parents, inner_rows, outer_rows): what the inner and the outer flatten return, without flattening."""
    n = F.greatest(F.coalesce(F.size(array), F.lit(0)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("parents"), F.sum(n).alias("inner_rows"), F.sum(F.greatest(n, F.lit(1))).alias("outer_rows"))


def collected_empty(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, n_rows): groups with rows whose collected array is empty, as every value is NULL and NULLs are ignored."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count(value).alias("held")).where("held = 0").drop("held")


def outer_elements(df: DataFrame, keys: list[str], array: Column) -> DataFrame:
    """(keys, pos, element): an outer flatten; a row whose array is NULL or empty stays, with NULLs."""
    return df.select(*keys, F.posexplode_outer(array).alias("pos", "element"))
