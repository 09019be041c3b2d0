"""Replays: the same frame made twice, compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of both runs that a task counts about.
ROWS = 1_000_000


def _counted(make: Callable[[], DataFrame]) -> DataFrame:
    """(h, n): the hash of a row, and how many more of it the first run has. Rows are dealt by their hash into parts of
    bounded size before they are counted, so the memory of a task does not grow with the table."""
    runs = [make().select(F.xxhash64("*").alias("h"), F.lit(sign).cast("long").alias("n")) for sign in (1, -1)]
    parts = max(1, -(-2 * make().count() // ROWS))
    return runs[0].unionByName(runs[1]).repartition(parts, "h").groupBy("h").agg(F.sum("n").alias("n"))


def differences(make: Callable[[], DataFrame]) -> DataFrame:
    """(only_first, only_second): rows that one run has and the other lacks, repeated rows counted each.

    A frame with a nondeterministic function in a key or a filter differs from itself. Rows are compared by a hash of
    all columns.
    """
    n = _counted(make)
    return n.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_second"))
