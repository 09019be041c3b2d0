"""Units as exponent vectors beside measures: a map from a base unit to its exponent, {} for a plain number.

Products add exponents, quotients subtract them, and a base whose exponent becomes 0 is gone; what is added, compared
or summed has to agree. A NULL map is an unknown unit: it agrees with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions import column, scaled


def unit(**exponents: int) -> Column:
    """A fixed unit, as unit(usd=1, piece=-1)."""
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(exponents.items()) if v]
    return F.map_from_entries(F.array(*pairs)) if pairs else F.map_from_entries(F.array().cast("array<struct<key:string,value:int>>"))


def _joined(a: Column, b: Column, sign: int) -> Column:
    both = F.map_zip_with(a, b, lambda _, p, q: F.coalesce(p, F.lit(0)) + sign * F.coalesce(q, F.lit(0)))
    return F.map_filter(both, lambda _, n: n != 0)


def times(a: Column, b: Column) -> Column:
    return _joined(a, b, 1)


def over(a: Column, b: Column) -> Column:
    return _joined(a, b, -1)


def written(u: Column) -> Column:
    """base^exponent by name, joined by `*`; `1` for a plain number, NULL for an unknown unit."""
    parts = F.transform(F.array_sort(F.map_entries(u)), lambda e: F.concat(e.key, F.when(e.value == 1, "").otherwise(F.concat(F.lit("^"), e.value.cast("string")))))
    return F.when(u.isNotNull(), F.when(F.size(parts) == 0, "1").otherwise(F.array_join(parts, "*")))


def agree(a: Column, b: Column) -> Column:
    """May the two be added or compared? Not where one is unknown."""
    return F.coalesce(written(a) == written(b), F.lit(False))


def gathered(df: DataFrame, keys: list[str], inputs: list[str], measures: dict[str, str | Column], scale: int | None = None) -> DataFrame:
    """(keys, inputs, measures, rows): measures added up by group and by the columns that units are made of, with the number
    of rows. Units are then made for few rows, and `sums` takes these sums with rows="rows"."""
    by = [F.col(c).alias(f"__by_{c}") for c in inputs]
    # as aggregates of their group, so that a filter on a unit is not moved back to the rows
    x = df.groupBy(*keys, *by).agg(*(F.min(c).alias(c) for c in inputs), *(F.sum(scaled(m, scale)).alias(n) for n, m in measures.items()), F.count("*").alias("rows"))
    return x.drop(*(f"__by_{c}" for c in inputs))


def sums(df: DataFrame, keys: list[str], measure: str | Column, of: Column, scale: int | None = None, rows: str | Column | None = None) -> DataFrame:
    """(keys, total, unit, units, unknown): the sum of a measure and its unit by group; where rows disagree or a unit is
    unknown the sum has no meaning and is NULL, with the number of units and of rows of unknown unit. `rows` says for how
    many rows a row stands."""
    n = F.count("*") if rows is None else F.sum(column(rows))
    x = df.groupBy(*keys, written(of).alias("__unit")).agg(F.sum(scaled(measure, scale)).alias("__sum"), n.alias("__rows"))
    # a row a unit: the units are counted as rows
    unknown = F.coalesce(F.sum(F.when(F.col("__unit").isNull(), F.col("__rows"))), F.lit(0))
    x = x.groupBy(*keys).agg(F.sum("__sum").cast("double").alias("total"), F.min("__unit").alias("unit"), F.count("__unit").alias("units"), unknown.alias("unknown"))
    sound = (F.col("units") == 1) & (F.col("unknown") == 0)
    return x.select(*keys, F.when(sound, F.col("total")).alias("total"), F.when(sound, F.col("unit")).alias("unit"), "units", "unknown")
