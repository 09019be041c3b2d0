"""Column expressions that the operators and contracts share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Two decimals, so that sums do not depend on the order of the rows."""
    return column(c).cast("decimal(18,2)")


def scaled(c: Column | str, scale: int | None = None) -> Column:
    """A measure with so many decimals, for exact sums; as it is where none are named."""
    return column(c) if scale is None else column(c).cast(f"decimal(28,{scale})")


def total(c: Column | str, scale: int | None = None) -> Column:
    """A sum as a double: of the numbers as they are, or exact in so many decimals."""
    return F.sum(scaled(c, scale)).cast("double")


def surrogate_key(*columns: str | Column, separator: str = "-", escaped: bool = False) -> Column:
    """MD5 of the columns as text, NULL as _null_.

    As it is usually written, inputs that hold the separator (or the text _null_) can share a key; `escaped` marks
    them with backslashes, so that the hashed text determines the inputs.
    """
    text = [column(c).cast("string") for c in columns]
    if escaped:
        back = F.lit("\\")
        text = [F.coalesce(F.replace(F.replace(t, back, F.lit("\\\\")), F.lit(separator), F.lit("\\" + separator)), F.lit("\\N")) for t in text]
    return F.md5(F.concat_ws(separator, *(F.coalesce(t, F.lit("_null_")) for t in text)))


def none_of(*columns: str) -> Column:
    """True where none of the columns is NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def field_check(column: str, ge=None, gt=None, le=None, lt=None, multiple_of=None, min_length=None, max_length=None) -> Column:
    """True where a declared bound fails; NULL passes every bound."""
    c, bad = F.col(column), F.lit(False)
    for bound, test in ((ge, lambda v: c < v), (gt, lambda v: c <= v), (le, lambda v: c > v), (lt, lambda v: c >= v), (multiple_of, lambda v: c % v != 0), (min_length, lambda v: F.length(c) < v), (max_length, lambda v: F.length(c) > v)):
        if bound is not None:
            bad = bad | F.coalesce(test(bound), F.lit(False))
    return bad
