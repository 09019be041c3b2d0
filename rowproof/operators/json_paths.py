"""What is in a column of JSON of any depth: its paths, their types, and which are not always there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.plans.lineage import kept

#: Names of types here by the first word that Spark gives a value.
_TYPES = {"BIGINT": "integer", "DOUBLE": "number", "DECIMAL": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}


def _typed(x: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(v) for pair in _TYPES.items() for v in pair))
    word = F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)
    return x.withColumn("type", F.coalesce(F.get(F.array(F.element_at(names, word)), F.lit(0)), F.when(F.col("v").isNull(), F.lit("invalid")).otherwise(F.lower(word))))


def values(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, up, type): a row for each value in the JSON text at any depth: `$`, `$.name`, `$.list[*]`; `up` is the
    path around it. Names other than words are quoted. Text that is no JSON is a value of type `invalid`; NULL has none.

    Each round opens the objects and arrays that the last one found, so there are as many rounds as levels.
    """
    spark = df.sparkSession
    level = _typed(df.where(F.col(json_col).isNotNull()).select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("up"), F.try_parse_json(json_col).alias("v")))
    out = level.drop("v")
    level = level.where("type in ('object', 'array')")
    while True:
        inner = level.alias("o").lateralJoin(spark.tvf.variant_explode(F.col("o.v").outer()).alias("e"))
        name = F.when(F.col("e.key").isNull(), "[*]").when(F.col("e.key").rlike(r"^\w+$"), F.concat(F.lit("."), F.col("e.key"))).otherwise(F.concat(F.lit("["), F.to_json(F.array("e.key")), F.lit("]")))
        level = _typed(inner.select(F.col("o.id").alias("id"), F.concat(F.col("o.path"), name).alias("path"), F.col("o.path").alias("up"), F.col("e.value").alias("v")))
        found = kept(level.select("id", "path", "up", "type", F.when(F.col("type").isin("object", "array"), F.to_json("v")).alias("text")))
        if found.isEmpty():
            return out
        out = out.unionByName(found.drop("text"))
        level = found.where("text is not null").withColumn("v", F.parse_json("text")).drop("text")


def profile(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(path, types, n_values, n_rows, optional, mixed): for each path its types in order, its values, the rows (ids) that
    have it, whether some object around it lacks it, and whether values that are not null have several types."""
    x = kept(values(df, id_col, json_col))
    own = x.groupBy("path", "up").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n_values"), F.count_distinct("id").alias("n_rows"))
    around = x.where("type = 'object'").groupBy(F.col("path").alias("up")).agg(F.count("*").alias("objects"))
    several = F.size(F.array_remove("types", "null")) > 1
    inside = ~F.col("path").endswith("[*]")
    return own.join(around, "up", "left").select("path", "types", "n_values", "n_rows", F.coalesce(inside & (F.col("objects") > F.col("n_values")), F.lit(False)).alias("optional"), several.alias("mixed"))
