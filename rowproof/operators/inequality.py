"""Joins on inequalities and overlaps counted without building a pair.

Values are added up before they meet, so a very common value is one row. They are dealt into ranges; sums of whole ranges
are carried across the borders and running sums go on inside each, so no task orders more than its range. The added-up
values are kept in the shared folder, so the rows themselves are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowproof.functions import column
from rowproof.sources.shared import kept

#: Ranges that values are dealt into at least: rows of the only frame that one task orders as a whole.
PARTS = 64
#: Values of a range about, where there are more.
VALUES = 1_000_000


def _range(at: Column, cuts: list[float], first: int = 0) -> Column:
    """In which range a number is: how many cuts are below it, found by halves."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(at > cuts[mid], _range(at, cuts[mid + 1 :], first + mid + 1)).otherwise(_range(at, cuts[:mid], first))


def below(left: DataFrame, left_value: str | Column, right: DataFrame, right_value: str | Column, strict: bool = True, parts: int = PARTS, left_rows: str | None = None, right_rows: str | None = None) -> DataFrame:
    """(value, n_left, n_below): for each value of the left side its rows, and how many rows of the right side have a
    smaller one (or the same, if not strict). NULLs meet nothing. Values are numbers, dates or times. `left_rows` and
    `right_rows` are columns that say for how many rows a row stands."""
    n = lambda rows: F.count("*") if rows is None else F.sum(rows)
    a = left.groupBy(column(left_value).alias("value")).agg(n(left_rows).alias("n_left"), F.lit(0).cast("long").alias("n_right"))
    b = right.groupBy(column(right_value).alias("value")).agg(F.lit(0).cast("long").alias("n_left"), n(right_rows).alias("n_right"))
    x = kept(a.unionByName(b).where("value is not null").groupBy("value").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")), "values")
    kind = x.schema["value"].dataType.typeName()
    at = {"date": F.unix_date("value"), "timestamp": F.unix_micros("value"), "timestamp_ntz": F.unix_micros(F.col("value").cast("timestamp"))}.get(kind, F.col("value")).cast("double")
    x = x.withColumn("at", at)
    parts = max(parts, x.count() // VALUES) if parts > 1 else 1
    cuts = sorted(set(x.stat.approxQuantile("at", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    x = x.withColumn("part", _range(F.col("at"), cuts))
    sums = x.groupBy("part").agg(F.sum("n_right").alias("held"))
    before = sums.withColumn("before", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    x = x.withColumn("inside", F.coalesce(F.sum("n_right").over(inside), F.lit(0))).join(F.broadcast(before), "part")  # a row a range
    return x.where("n_left > 0").select("value", "n_left", (F.col("before") + F.col("inside")).alias("n_below"))


def overlaps(left: DataFrame, right: DataFrame, start: str, end: str, parts: int = PARTS, rows: str | None = None) -> DataFrame:
    """(start, end, n_left, n_overlaps): for each interval of the left side its rows, and how many intervals of the right
    side share a point with it (ends belong to intervals). Intervals with a NULL, or that end before they start, overlap
    with nothing. `rows` is a column of both sides that says for how many rows a row stands."""
    valid = f"`{start}` <= `{end}`"
    added = lambda df: kept(df.groupBy(start, end).agg((F.count("*") if rows is None else F.sum(rows)).alias("n_left")), "intervals")
    own = added(left)
    l, r = own.where(valid), (own if right is left else added(right)).where(valid)
    begun = below(l, end, r, start, strict=False, parts=parts, left_rows="n_left", right_rows="n_left").select(F.col("value").alias(end), F.col("n_below").alias("begun"))
    over = below(l, start, r, end, parts=parts, left_rows="n_left", right_rows="n_left").select(F.col("value").alias(start), F.col("n_below").alias("over"))
    # what ended before this one starts has begun before it ends
    n = F.when(F.expr(valid), F.col("begun") - F.col("over")).otherwise(0)
    return own.join(begun, end, "left").join(over, start, "left").select(start, end, "n_left", F.coalesce(n, F.lit(0)).alias("n_overlaps"))
