"""Hazards of joins and of NULLs that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions import column, scaled, total


def null_group(left: DataFrame, right: DataFrame, on: Column, key: str, measure: str, scale: int | None = None) -> DataFrame:
    """(key, n_rows, total): the group that outer-join padding makes of preserved rows without a partner, all under NULL.

    `key` is a column of the right side; rows with a partner whose key is NULL are not padding.
    """
    lost = left.join(right, on, "left_anti").agg(F.count("*").alias("n_rows"), total(measure, scale).alias("total")).where("n_rows > 0")
    return lost.select(F.lit(None).cast(right.schema[key].dataType).alias(key), "n_rows", "total")


def right_padding(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows that a RIGHT join pads: those without a partner in all that was joined before."""
    return right.join(left, on, "left_anti")


def either(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """left JOIN right ON left.a = right.b OR left.c = right.d, as one join on keys: (left, right) with each row whole.

    Both sides go once to each of the two keys; a pair that both keys bring together is there once. The sides are
    structs, so they may share column names.
    """
    side = lambda df, name, keys: df.select(F.struct(*df.columns).alias(name), F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(k).cast("string").alias("k")) for i, k in enumerate(keys)))).alias("on")).where("on.k is not null")
    x = side(left, "left", (first[0], second[0])).join(side(right, "right", (first[1], second[1])), "on")
    both = F.coalesce(F.col("left")[first[0]] == F.col("right")[first[1]], F.lit(False))
    return x.where((F.col("on.which") == 0) | ~both).select("left", "right")


def cross_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_rows, right_rows, pairs): what a cross join would return, without building it."""
    a, b = left.agg(F.count("*").alias("left_rows")), right.agg(F.count("*").alias("right_rows"))
    return a.join(F.broadcast(b)).withColumn("pairs", F.col("left_rows") * F.col("right_rows"))  # one row each


def sentinel_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, sentinel) -> DataFrame:
    """Pairs that match on coalesce(key, sentinel) and not on the keys themselves, per sentinel value."""
    a = left.select(F.col(left_key).alias("a"), F.coalesce(left_key, F.lit(sentinel)).alias("k"))
    b = right.select(F.col(right_key).alias("b"), F.coalesce(right_key, F.lit(sentinel)).alias("k"))
    # counted per key on both sides before the join: no pair is ever built
    a = a.groupBy("k").agg(F.count("*").alias("na"), F.count("a").alias("ra"))
    b = b.groupBy("k").agg(F.count("*").alias("nb"), F.count("b").alias("rb"))
    return a.join(b, "k").select("k", (F.col("na") * F.col("nb") - F.col("ra") * F.col("rb")).alias("false_matches")).where("false_matches > 0")


def lost_to_where(left: DataFrame, right: DataFrame, on: Column, predicate: Column) -> DataFrame:
    """Preserved rows that a WHERE on the padded side drops after a left join."""
    return left.join(right.where(predicate), on, "left_anti")


def fanout(left: DataFrame, right: DataFrame, left_key: str | Column, right_key: str | Column) -> DataFrame:
    """(matches, left_rows): how many rows of the left side meet how many partners; keys may be functions of columns."""
    b = right.groupBy(column(right_key).alias("k")).agg(F.count("*").alias("m"))
    a = left.select(column(left_key).alias("k")).join(b, "k", "left")
    return a.groupBy(F.coalesce("m", F.lit(0)).alias("matches")).agg(F.count("*").alias("left_rows"))


def inflated_sum(left: DataFrame, right: DataFrame, left_key: str, right_key: str, group: str, measure: str, scale: int | None = None) -> DataFrame:
    """(group, at_origin, after_join): a sum of the left side's measure before and after a join that repeats rows."""
    b = right.groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("m"))
    joined = left.join(b, left[left_key] == b["k"], "left")
    times = F.coalesce("m", F.lit(0))
    after = F.sum(scaled(measure, scale) * times).cast("double")
    return joined.groupBy(group).agg(total(measure, scale).alias("at_origin"), after.alias("after_join")).where("at_origin <> after_join")


def key_loss(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(side, n_rows, null_keys, unmatched): rows that an inner join on a nullable key drops, by side."""

    def side(name: str, own: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
        keys = other.select(F.col(other_key).alias("k")).where("k is not null").distinct().withColumn("hit", F.lit(1))
        x = own.select(F.col(key).alias("k")).join(keys, "k", "left")
        return x.agg(F.count("*").alias("n_rows"), F.count_if(F.col("k").isNull()).alias("null_keys"), F.count_if(F.col("k").isNotNull() & F.col("hit").isNull()).alias("unmatched")).select(F.lit(name).alias("side"), "n_rows", "null_keys", "unmatched")

    return side("left", left, left_key, right, right_key).unionByName(side("right", right, right_key, left, left_key))


def not_in_trap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(not_in_rows, not_exists_rows): one NULL in the subquery makes NOT IN return nothing."""
    r = right.agg(F.count("*").alias("n"), F.count_if(F.col(right_key).isNull()).alias("nulls"))
    keys = right.select(F.col(right_key).alias("k")).where("k is not null")
    a = left.select(F.col(left_key).alias("k"))
    missing = a.join(keys, "k", "left_anti").agg(F.count("*").alias("missing"), F.count_if(F.col("k").isNull()).alias("null_probes"))
    both = missing.join(F.broadcast(r))  # one row and one row
    not_in = F.when(F.col("n") == 0, F.col("missing")).when(F.col("nulls") > 0, 0).otherwise(F.col("missing") - F.col("null_probes"))
    return both.select(not_in.cast("long").alias("not_in_rows"), F.col("missing").alias("not_exists_rows"))


def null_probes_kept(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows that an anti join keeps only because their own key is NULL."""
    keys = right.select(F.col(right_key).alias(left_key))
    return left.join(keys, left_key, "left_anti").where(F.col(left_key).isNull())


def padded_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(kind, n): for a full join the matched pairs and the rows padded on each side."""
    a = left.groupBy(F.col(left_key).alias("k")).agg(F.count("*").alias("na"))
    b = right.groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("nb"))
    x = a.join(b, "k", "full")
    kind = F.when(F.col("nb").isNull(), "left only").when(F.col("na").isNull(), "right only").otherwise("matched")
    n = F.when(F.col("nb").isNull(), F.col("na")).when(F.col("na").isNull(), F.col("nb")).otherwise(F.col("na") * F.col("nb"))
    return x.groupBy(kind.alias("kind")).agg(F.sum(n).alias("n"))


def within_intervals(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with low <= value <= high: a range join as an equi-join on steps of `width`.

    Each interval is repeated once per step that it touches; a value lies in one step, so no pair is built twice.
    """
    step = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("__step", F.explode(F.sequence(step(low), step(high))))
    return points.withColumn("__step", step(value)).join(spread, "__step").where(F.col(value).between(F.col(low), F.col(high))).drop("__step")


def key_unit_mismatch(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_unit: str, right_unit: str) -> DataFrame:
    """(left_unit, right_unit, pairs): matches of a join whose two sides carry different units."""
    a = left.groupBy(F.col(left_key).alias("k"), F.col(left_unit).alias("left_unit")).agg(F.count("*").alias("na"))
    b = right.groupBy(F.col(right_key).alias("k"), F.col(right_unit).alias("right_unit")).agg(F.count("*").alias("nb"))
    pairs = a.join(b, "k").where("left_unit <> right_unit")
    return pairs.groupBy("left_unit", "right_unit").agg(F.sum(F.col("na") * F.col("nb")).cast("long").alias("pairs"))
