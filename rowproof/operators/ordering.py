"""Hazards of order: rankings, ordered aggregates and cut-offs whose result the data does not decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowproof.operators.inequality import below


def arbitrary_labels(df: DataFrame, partition: list[str]) -> DataFrame:
    """(size, partitions): partitions whose rows an unordered ranking numbers at will, by their size."""
    sizes = df.groupBy(*partition).agg(F.count("*").alias("size")).where("size > 1")
    return sizes.groupBy("size").agg(F.count("*").alias("partitions"))


def order_ties(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Tied groups: rows that a window's partition and order keys do not tell apart."""
    return df.groupBy(*partition, *order).agg(F.count("*").alias("tied")).where("tied > 1")


def order_dependent_groups(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups whose collected list depends on row order: those with more than one distinct value."""
    x = df.groupBy(*keys).agg(F.count_distinct(value).alias("values"), F.count("*").alias("n_rows"))
    return x.where("values > 1")


def top_n_ties(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """(keys, reached): groups in which more than n rows rank within the first n, so a top-n is arbitrary.

    Rows are counted per order value first; the window then runs over values, not rows.
    """
    values = df.groupBy(*keys, order).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    before = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n)
    return ranked.groupBy(*keys).agg(F.sum("c").alias("reached")).where(F.col("reached") > n)


def cutoff_ties(df: DataFrame, order: str, n: int) -> DataFrame:
    """(cutoff, tied, taken): rows that share the order value at which LIMIT n cuts, and how many of them it takes.

    Only the first n values are ordered (each task keeps n); the rest is two counts.
    """
    x = df.select(F.col(order).alias("v"))
    cut = x.orderBy("v").offset(n - 1).limit(1).select(F.col("v").alias("cutoff"))
    earlier = F.coalesce(F.col("v") < F.col("cutoff"), F.col("v").isNull() & F.col("cutoff").isNotNull())  # NULLs are first
    counts = x.join(F.broadcast(cut)).groupBy("cutoff").agg(F.count_if(F.col("v").eqNullSafe(F.col("cutoff"))).alias("tied"), F.count_if(earlier).alias("before"))  # one row
    return counts.where(F.col("before") + F.col("tied") > n).select("cutoff", "tied", (F.lit(n) - F.col("before")).alias("taken"))


def page_ties(df: DataFrame, order: str, size: int) -> DataFrame:
    """(value, tied, first_page, last_page): order values whose rows lie on more than one page of LIMIT size OFFSET
    page * size, so that a row may come on two of these pages or on none. Pages are numbered from 0.

    Rows are counted by value and the counts added up by ranges, so all pages of a table are had without ordering its rows.
    NULLs come first, as Spark orders them. Values are numbers, dates or times.
    """
    nulls = df.agg(F.count_if(F.col(order).isNull()).alias("nulls"))
    known = below(df, order, df, order).select("value", F.col("n_left").alias("tied"), F.col("n_below").alias("before"))
    x = known.join(F.broadcast(nulls)).withColumn("before", F.col("before") + F.col("nulls")).drop("nulls")  # one row
    x = x.unionByName(nulls.select(F.lit(None).cast(known.schema["value"].dataType).alias("value"), F.col("nulls").alias("tied"), F.lit(0).cast("long").alias("before")).where("tied > 0"))
    page = lambda at: F.floor(at / size).cast("long")
    x = x.select("value", "tied", page(F.col("before")).alias("first_page"), page(F.col("before") + F.col("tied") - 1).alias("last_page"))
    return x.where("last_page > first_page")


def first_known(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """(keys, first, first_known): a group's first value in a total order, and its first that is not NULL (IGNORE NULLS)."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.min_by(value, F.when(value.isNotNull(), at)).alias("first_known"))


def recent_counts(df: DataFrame, partition: list[str], at: str, seconds: int) -> DataFrame:
    """Add n_recent: rows of the partition within so many seconds up to each row's time, peers included (a RANGE frame)."""
    w = Window.partitionBy(*partition).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("n_recent", F.count("*").over(w))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """(keys, percentile): each group's smallest value that at least a share p of its known values does not exceed.

    A sketch (of bounded size, off by a ten-thousandth of the ranks at most) finds an interval around it, so only a
    group's values within a thousandth of that rank are ordered; all others are counted. Groups without a known value
    are left out.
    """
    x = df.select(*keys, F.col(value).alias("__v")).where("__v is not null")
    near = F.percentile_approx("__v", [max(p - 0.001, 0.0), min(p + 0.001, 1.0)], 10_000)
    ends = x.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(near.alias("__near"), F.count("*").alias("__n"))
    x = x.join(ends, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).where(F.col("__v") <= F.col("__near")[1])
    counted = x.groupBy(*keys, "__n", F.when(F.col("__v") >= F.col("__near")[0], F.col("__v")).alias("__at")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("__c", F.sum("__c").over(w)).where(F.col("__at").isNotNull() & (F.col("__c") >= F.ceil(F.lit(p) * F.col("__n"))))
    return reached.groupBy(*keys).agg(F.min("__at").alias("percentile"))
