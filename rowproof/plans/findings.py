"""Findings as rows: severity, baseline, worlds, coverage.

findings(family, kind, model, column_name, world, message): one row per observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds whose default level is error; all others warn.
ERRORS = (
    "null_group_after_outer_join", "coalesce_on_join_key", "where_on_outer_joined_nullable", "inner_flatten_row_drop", "non_unique_window_order_keys", "null_group_on_nullable_key", "join_on_nullable_key",
    "not_in_nullable_subquery", "snapshot_temporal_filter_missing", "contract_issue", "domain_type_contradiction", "aggregation_not_well_typed", "join_key_type_mismatch",
)
#: Kinds whose default level is warn.
WARNINGS = (
    "unordered_ranking_window", "unordered_aggregate", "non_unique_aggregate_order_keys", "limit_without_deterministic_order", "non_deterministic_function", "join_fanout", "cross_model_fanout", "resolution_below_floor",
)
IDENTITY = ("family", "kind", "model", "column_name")


def severity(kind: Column | str) -> Column:
    return F.when((F.col(kind) if isinstance(kind, str) else kind).isin(*ERRORS), "error").otherwise("warn")


def introduced(now: DataFrame, before: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Findings of `now` whose identity `before` does not have (NULLs are equal)."""
    marked = before.select(*(F.col(c).alias(f"__{c}") for c in identity)).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in identity]
    return now.join(marked, on, "left_anti")


def only_in_some_worlds(found: DataFrame, worlds: list[str] | DataFrame, identity: tuple[str, ...] = IDENTITY, world: str = "world") -> DataFrame:
    """(identity, worlds): findings that hold in a strict subset of the analysed worlds.

    `worlds` names all that were analysed (a list, or a frame with a row for each), so a world without any finding
    counts; findings of worlds that are not among them are left out.
    """
    spark = found.sparkSession
    named = spark.createDataFrame([(w,) for w in worlds], "w string") if isinstance(worlds, list) else worlds.select(F.col(worlds.columns[0]).alias("w"))
    named = named.distinct()
    n = named.agg(F.count("*").alias("n_analysed"))
    held = found.join(named, F.col(world) == F.col("w"), "left_semi").groupBy(*identity).agg(F.array_sort(F.collect_set(world)).alias("worlds"))
    return held.join(F.broadcast(n)).where(F.size("worlds") < F.col("n_analysed")).drop("n_analysed")  # one row


def suppressed(found: DataFrame, directives: DataFrame, identity: tuple[str, ...] = ("model", "kind")) -> DataFrame:
    """Findings without those that a directive (model, kind; NULL kind: all kinds) covers."""
    d = directives.select(F.col("model").alias("__m"), F.col("kind").alias("__k"))
    return found.join(d, (F.col("model") == F.col("__m")) & (F.col("__k").isNull() | (F.col("__k") == F.col("kind"))), "left_anti")


def passes(found: DataFrame, fail_on: str = "error") -> DataFrame:
    """(findings, failing, passed): the gate at a level."""
    level = F.lit(True) if fail_on == "warn" else severity("kind") == "error"
    x = found.agg(F.count("*").alias("findings"), F.count_if(level).alias("failing"))
    return x.withColumn("passed", F.col("failing") == 0)


def coverage(checked: DataFrame, floor: float = 0.0) -> DataFrame:
    """(model, declared, checked, share, kind): how many of a model's declared facts could be checked.

    checked(model, status): a row per declared fact; status is "checked" or why not. Models whose share is below the
    floor have the kind resolution_below_floor, others none.
    """
    x = checked.groupBy("model").agg(F.count("*").alias("declared"), F.count_if(F.col("status") == "checked").alias("checked"))
    x = x.withColumn("share", F.col("checked") / F.col("declared"))
    return x.withColumn("kind", F.when(F.col("share") < floor, "resolution_below_floor"))


def grounding(checked: DataFrame) -> DataFrame:
    """(property, declared, grounded): how many facts of each property could be checked, over all models."""
    return checked.groupBy("property").agg(F.count("*").alias("declared"), F.count_if(F.col("status") == "checked").alias("grounded"))


def least_covered(checked: DataFrame, n: int = 5) -> DataFrame:
    """coverage() of the n models with the lowest share of checked facts; of equal shares those with more unchecked
    facts first, then by name."""
    return coverage(checked).drop("kind").orderBy("share", (F.col("checked") - F.col("declared")), "model").limit(n)


def write(found: DataFrame, path: str, kind: str = "json") -> None:
    """Write findings with their level, as files of a kind that Spark writes."""
    found.withColumn("severity", severity("kind")).write.mode("overwrite").format(kind).save(path)
