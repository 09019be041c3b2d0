"""Incremental loads: strategies, and what each keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.operators.facts import first_per_key

#: Strategies that replace rows of the same key.
DEDUPLICATES = {"append": False, "merge": True, "delete+insert": True, "insert_overwrite": False, "microbatch": False}


def effective(declared: Column, default: str | None) -> Column:
    """The strategy in force: the declared one, else the platform's default; NULL where it is not one of the known."""
    name = F.lower(F.trim(F.coalesce(declared, F.lit(default))))
    return F.when(name.isin(*DEDUPLICATES), name)


def deduplicates(strategy: Column) -> Column:
    """Does a load of this strategy leave one row per key? Not if it is unknown."""
    return F.coalesce(strategy.isin(*(s for s, one in DEDUPLICATES.items() if one)), F.lit(False))


def load(target: DataFrame, batch: DataFrame, strategy: str, keys: list[str], order: list[Column], partition: str | None = None) -> DataFrame:
    """The target after a batch: append adds; merge and delete+insert replace rows of the batch's keys (of several
    batch rows of a key the first in `order` for merge, all for delete+insert); insert_overwrite and microbatch
    replace whole values of `partition`."""
    if strategy == "append":
        return target.unionByName(batch)
    if strategy in ("merge", "delete+insert"):
        new = first_per_key(batch, keys, order) if strategy == "merge" else batch
        return target.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    if strategy in ("insert_overwrite", "microbatch"):
        return target.join(batch.select(partition).distinct(), partition, "left_anti").unionByName(batch)
    raise ValueError(f"unknown strategy: {strategy}")


def late_rows(target: DataFrame, source: DataFrame, at: str) -> DataFrame:
    """Source rows that `where at > (select max(at) from target)` passes over though the target lacks their day's tail."""
    high = target.agg(F.max(at).alias("__high"))
    return source.join(F.broadcast(high)).where(F.col(at) <= F.col("__high")).drop("__high")  # one row
