"""Versioned tables (slowly changing dimensions of type 2) and how they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def versions(df: DataFrame, keys: list[str], at: str, tie: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Add validity columns: from each row's time to the next row's of the same key (NULL: current)."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return df.withColumn(valid_from, F.col(at)).withColumn(valid_to, F.lead(at).over(w))


def version_fanout(history: DataFrame, keys: list[str], valid_to: str = "valid_to") -> DataFrame:
    """(keys, versions, current): keys with more than one version, which a read without a time filter repeats."""
    x = history.groupBy(*keys).agg(F.count("*").alias("versions"), F.count_if(F.col(valid_to).isNull()).alias("current"))
    return x.where("versions > 1")


def current(history: DataFrame, valid_to: str = "valid_to") -> DataFrame:
    """The current version of each key."""
    return history.where(F.col(valid_to).isNull())


def as_of(history: DataFrame, moment: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """The versions valid at a moment."""
    return history.where((F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (F.col(valid_to) > moment)))
