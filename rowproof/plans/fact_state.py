"""Facts re-verified from stored state: a load reads its own rows and the state of its keys, and no earlier rows.

The state is a table of key counts, a segment for each load, partitioned by a hash range (bucket) of the key, and a
table with one row a load of what merges: row counts, NULL counts and sketches. A load appends its segment; what it
breaks is found in the buckets that its keys are in, so a load of few keys reads few files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class KeyState:
    """The stored state of a declared key (and the NULLs and distinct values of other columns) of a table.

    A NULL in the key is no duplicate. Loads are named; a load that is absorbed again replaces itself, so a job that
    was cut short can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], columns: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.columns, self.buckets = spark, path.rstrip("/"), keys, columns or [], buckets
        self.schema: StructType | None = None  # of a segment, once a load has been absorbed here: there may be no rows to tell

    def _counted(self, load: DataFrame) -> DataFrame:
        known = load
        for k in self.keys:
            known = known.where(F.col(k).isNotNull())
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return known.groupBy(*self.keys).agg(F.count("*").alias("n_rows")).withColumn("bucket", bucket)

    def absorb(self, load: DataFrame, name: str) -> None:
        """Write the load's segment: one shuffle of its distinct keys."""
        segment, counted = f"{self.path}/keys/load={name}", self._counted(load)
        self.schema = counted.schema
        counted.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(segment)
        totals = [F.count("*").alias("n_rows"), F.count_if(F.greatest(*(F.col(k).isNull().cast("int") for k in self.keys), F.lit(0)) > 0).alias("null_keys")]
        totals += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in self.columns]
        totals += [F.hll_sketch_agg(F.col(c), F.lit(14)).alias(f"sketch_{c}") for c in self.columns]
        load.agg(*totals).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/load={name}")

    def stored(self) -> DataFrame:
        """(keys, n_rows, load, bucket): all segments."""
        read = self.spark.read.option("basePath", f"{self.path}/keys")
        read = read if self.schema is None else read.schema(StructType([*self.schema, StructField("load", StringType())]))
        return read.parquet(f"{self.path}/keys/load=*").withColumn("load", F.col("load").cast("string"))

    def broken(self) -> DataFrame:
        """(keys, n): keys on more than one row of all loads, from the state alone."""
        return self.stored().groupBy(*self.keys).agg(F.sum("n_rows").alias("n")).where("n > 1")

    def broken_by(self, load: DataFrame) -> DataFrame:
        """(keys, n): keys of a load that is not absorbed yet which would be on more than one row with it.

        Reads the load, and of the state the buckets that the load's keys are in (their numbers, `buckets` at most, are
        read first so that the scan can leave out the others).
        """
        own = self._counted(load)
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]
        before = self.stored().where(F.col("bucket").isin(touched)).select(*self.keys, "n_rows", F.lit(False).alias("own"))
        both = before.unionByName(own.select(*self.keys, "n_rows", F.lit(True).alias("own")))
        return both.groupBy(*self.keys).agg(F.sum("n_rows").alias("n"), F.bool_or("own").alias("own")).where("own and n > 1").drop("own")

    def totals(self) -> DataFrame:
        """(column_name, n_rows, nulls, about): for each column its NULLs, and about how many values, from all loads' totals."""
        x = self.spark.read.option("basePath", f"{self.path}/totals").parquet(f"{self.path}/totals/load=*")
        merged = x.agg(F.sum("n_rows").alias("n_rows"), *(F.sum(f"nulls_{c}").alias(f"nulls_{c}") for c in self.columns), *(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"about_{c}") for c in self.columns))
        rows = (F.struct(F.lit(c).alias("column_name"), "n_rows", F.col(f"nulls_{c}").alias("nulls"), F.col(f"about_{c}").alias("about")) for c in self.columns)
        return merged.select(F.inline(F.array(*rows)))
