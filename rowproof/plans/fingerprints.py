"""The difference of two builds of a table by a tree of fingerprints.

A stored build has, for each hash range of its key, an order-free fingerprint of its rows; ranges add up to wider ones,
level by level, to one fingerprint of the whole. Builds are compared from the top: only ranges that differ are opened,
and only the rows of the leaves that differ are read again and compared, key by key and column by column. What is read
grows with the changes, not with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Leaves of the tree, and the ranges that make one of the next level.
LEAVES, FAN = 256, 16


@dataclass(frozen=True)
class Build:
    """A build stored under a path: rows by leaf, and the fingerprints of all levels."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType

    def rows(self, leaves: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col("leaf").isin(leaves))

    def tree(self) -> DataFrame:
        """(level, node, n_rows, mark): level 0 is the whole."""
        return self.spark.read.parquet(f"{self.path}/tree")


def store(df: DataFrame, path: str, keys: list[str], leaves: int = LEAVES, fan: int = FAN) -> Build:
    """Write a build: its rows once, in one shuffle, and its fingerprints from what was written."""
    spark, path = df.sparkSession, path.rstrip("/")
    leaf = F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")
    df = df.withColumn("leaf", leaf)
    df.repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/rows")
    # sums of two independent hashes, in wide numbers: no order, and repeated rows count
    x = spark.read.schema(df.schema).parquet(f"{path}/rows")
    names = sorted(set(df.columns) - {"leaf"})
    marks = [F.sum(F.xxhash64(*more, *names).cast("decimal(38,0)")).alias(m) for m, more in (("a", []), ("b", [F.lit("second")]))]
    at = x.groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n_rows"), *marks)
    widths = [leaves]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // fan))
    level = len(widths) - 1
    spread = F.explode(F.array(*(F.struct(F.lit(level - i).alias("level"), F.floor(F.col("node") / fan**i).cast("int").alias("at")) for i in range(len(widths)))))
    tree = at.select(spread.alias("up"), "n_rows", "a", "b").groupBy(F.col("up.level").alias("level"), F.col("up.at").alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.concat_ws(":", F.sum("a"), F.sum("b")).alias("mark"))
    tree.coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
    return Build(spark, path, tuple(keys), df.schema)


def different_leaves(first: Build, second: Build, fan: int = FAN) -> list[int]:
    """The leaves whose rows differ: level by level, only below ranges that differ. A tree has LEAVES entries or so."""
    open_: list[int] = [0]
    levels = first.tree().agg(F.max("level")).first()[0] or second.tree().agg(F.max("level")).first()[0] or 0
    for level in range(levels + 1):
        side = lambda b, name: b.tree().where((F.col("level") == level) & F.col("node").isin(open_)).select("node", F.struct("n_rows", "mark").alias(name))  # noqa: B023, E731
        both = side(first, "x").join(side(second, "y"), "node", "full").where(~F.col("x").eqNullSafe(F.col("y")))
        differ = sorted(r["node"] for r in both.select("node").collect())
        if not differ or level == levels:
            return differ
        open_ = [n * fan + k for n in differ for k in range(fan)]
    return []


def differences(first: Build, second: Build, fan: int = FAN) -> DataFrame:
    """(kind, column_name, n): rows `only_first` and `only_second`, and for each column the rows of both builds that are
    `changed` in it (NULLs are equal; rows of the two builds belong together where a key has one row left in each).

    Equal rows cancel out before keys are compared, so a key with very many rows is no hot group.
    """
    leaves = different_leaves(first, second, fan)
    keys = list(first.keys)
    a, b = (x.rows(leaves).drop("leaf") for x in (first, second))
    values = [c for c in a.columns if c not in keys]
    left = a.withColumn("sign", F.lit(1)).unionByName(b.withColumn("sign", F.lit(-1))).groupBy(*a.columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    row = lambda held: F.any_value(F.when(held, F.struct(*(values or keys))), True)
    sign = F.col("sign")
    x = left.groupBy(*keys).agg(F.sum(F.greatest(sign, F.lit(0))).alias("fx"), F.sum(F.greatest(-sign, F.lit(0))).alias("fy"), row(sign > 0).alias("x"), row(sign < 0).alias("y"))
    pair = (F.col("fx") == 1) & (F.col("fy") == 1)
    n = lambda c: F.coalesce(F.sum(F.when(~pair, c)), F.lit(0)).cast("long")
    changed = [F.count_if(pair & ~F.col("x")[c].eqNullSafe(F.col("y")[c])).alias(f"c{i}") for i, c in enumerate(values)]
    x = x.agg(n(F.col("fx")).alias("only_first"), n(F.col("fy")).alias("only_second"), *changed)
    out = [F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("column_name"), F.col(k).alias("n")) for k in ("only_first", "only_second")]
    out += [F.struct(F.lit("changed").alias("kind"), F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n")) for i, c in enumerate(values)]
    return x.select(F.inline(F.array(*out)))
