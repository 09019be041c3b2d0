"""Readers of project metadata: one JSON file becomes tables of nodes, columns, tests, edges and macros."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.plans.incremental import deduplicates, effective

_KINDS = ("model", "source", "seed", "snapshot")
_MATERIALIZED = ("view", "table", "incremental", "materialized_view", "ephemeral", "snapshot")


#: Sections of a project's file that are read, each a map from an identifier to an entry.
_SECTIONS = ("nodes", "sources")


def _entries(spark: SparkSession, path: str, *sections: str) -> DataFrame:
    """(section, uid, entry variant): the objects of top-level sections; missing sections, and those that are no
    objects, have none. A file that is no JSON object, or breaks off before either section has ended, is an error.

    The reader takes the file apart entry by entry, so that Spark's bound on one variant (128 MB) holds for an entry
    and not for the file; a file is read by one task and its entries are dealt out afterwards.
    """
    schema = ", ".join([*(f"{name} map<string, variant>" for name in _SECTIONS), "__unread string"])
    read = spark.read.json(path, schema, multiLine=True, columnNameOfCorruptRecord="__unread")
    unread = F.col("__unread").isNotNull() & F.coalesce(*_SECTIONS).isNull()
    sound = F.when(unread, F.raise_error(F.concat(F.lit("no project metadata: "), F.substring("__unread", 1, 80))))
    found = [F.transform(F.map_entries(F.coalesce(sound.cast("map<string, variant>"), name)), lambda e, name=name: F.struct(F.lit(name).alias("section"), e.key.alias("uid"), e.value.alias("entry"))) for name in sections]
    empty = F.array().cast("array<struct<section: string, uid: string, entry: variant>>")
    return read.select(F.explode(F.concat(*(F.coalesce(x, empty) for x in found))).alias("e")).select("e.*").repartition("uid")


def _exploded(df: DataFrame, path: str, name: str, within: str = "entry") -> DataFrame:
    """A row for each child (name.key of objects, name.value) of the variant at a path of each row's variant."""
    children = df.sparkSession.tvf.variant_explode_outer(F.try_variant_get(F.col(within).outer(), path, "variant"))
    return df.lateralJoin(children.select(F.struct("key", "value").alias(name)))


def _text(path: str):
    return F.try_variant_get("entry", path, "string")


def _known(c, values: tuple[str, ...]):
    c = F.lower(c)
    return F.when(c.isin(*values), c).otherwise("other")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """nodes(uid, name, kind, sql, status, materialized, strategy, unique_key, valid_from, valid_to, depends_on, path).

    Unknown kinds and materialisations are "other"; status says whether there is compiled SQL ("not_compiled" and
    "absent" are gaps, not empty models); nodes written in Python count as compiled.
    """
    x = _entries(spark, path, *_SECTIONS)
    sql = _text("$.compiled_code")
    status = F.when(_text("$.language") == "python", "compiled").when(sql.isNotNull() & (F.trim(sql) != ""), "compiled").when(F.try_variant_get("entry", "$.compiled", "boolean"), "absent").otherwise("not_compiled")
    keys = F.coalesce(F.try_variant_get("entry", "$.config.unique_key", "array<string>"), F.when(_text("$.config.unique_key").isNotNull(), F.array(_text("$.config.unique_key"))), F.array().cast("array<string>"))
    return x.select(
        "uid", F.coalesce(_text("$.identifier"), _text("$.alias"), _text("$.name")).alias("name"), _known(_text("$.resource_type"), _KINDS).alias("kind"), sql.alias("sql"), status.alias("status"),
        _known(_text("$.config.materialized"), _MATERIALIZED).alias("materialized"), _text("$.config.incremental_strategy").alias("strategy"), keys.alias("unique_key"),
        F.coalesce(_text("$.config.snapshot_meta_column_names.dbt_valid_from"), F.lit("dbt_valid_from")).alias("valid_from"), F.coalesce(_text("$.config.snapshot_meta_column_names.dbt_valid_to"), F.lit("dbt_valid_to")).alias("valid_to"),
        F.coalesce(F.try_variant_get("entry", "$.depends_on.nodes", "array<string>"), F.array().cast("array<string>")).alias("depends_on"), _text("$.original_file_path").alias("path"),
    )


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """columns(uid, name, data_type, description): documented columns (of a project's file) or found ones (of its
    catalog's file), names in lower case."""
    x = _exploded(_entries(spark, path, *_SECTIONS), "$.columns", "c").where("c.key is not null")
    kind = F.coalesce(F.try_variant_get("c.value", "$.data_type", "string"), F.try_variant_get("c.value", "$.type", "string"))
    return x.select("uid", F.lower("c.key").alias("name"), kind.alias("data_type"), F.try_variant_get("c.value", "$.description", "string").alias("description"))


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """tests(uid, target, name, column_name, columns, accepted, parent, parent_column, condition, enabled): declared
    generic tests, with the arguments of accepted_values and relationships (the parent is the target's other
    dependency).

    The target is the attached node, else the first of the sorted data-flow dependencies.
    """
    x = _entries(spark, path, "nodes").where(_text("$.resource_type") == "test").where(_text("$.test_metadata.name").isNotNull())
    flow = F.filter(F.coalesce(F.try_variant_get("entry", "$.depends_on.nodes", "array<string>"), F.array().cast("array<string>")), lambda n: ~n.startswith("macro."))
    return x.select(
        "uid", F.coalesce(_text("$.attached_node"), F.get(F.array_sort(flow), 0)).alias("target"), _text("$.test_metadata.name").alias("name"), F.lower(F.coalesce(_text("$.column_name"), _text("$.test_metadata.kwargs.column_name"))).alias("column_name"),
        F.try_variant_get("entry", "$.test_metadata.kwargs.combination_of_columns", "array<string>").alias("columns"), F.try_variant_get("entry", "$.test_metadata.kwargs.values", "array<string>").alias("accepted"),
        F.when(_text("$.test_metadata.name") == "relationships", F.get(F.filter(flow, lambda n: n != F.coalesce(_text("$.attached_node"), F.get(F.array_sort(flow), 0))), 0)).alias("parent"), F.lower(_text("$.test_metadata.kwargs.field")).alias("parent_column"), _text("$.config.where").alias("condition"), F.coalesce(F.try_variant_get("entry", "$.config.enabled", "boolean"), F.lit(True)).alias("enabled"),
    )


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """constraints(uid, type, columns): native constraints of models and of their columns, types in lower case."""
    x = _entries(spark, path, "nodes")
    model = _exploded(x, "$.constraints", "k").where("k.value is not null")
    model = model.select("uid", "k", F.transform(F.try_variant_get("k.value", "$.columns", "array<string>"), F.lower).alias("columns"))
    own = _exploded(x, "$.columns", "c").where("c.key is not null").select("uid", "c.key", "c.value")
    own = _exploded(own, "$.constraints", "k", within="value").where("k.value is not null").select("uid", "k", F.array(F.lower("key")).alias("columns"))
    kind = F.lower(F.try_variant_get("k.value", "$.type", "string"))
    return model.unionByName(own).select("uid", kind.alias("type"), "columns").where("type is not null and columns is not null")


def read_facts(spark: SparkSession, path: str, default_strategy: str | None = None) -> DataFrame:
    """facts(model, property, columns, accepted, parent, parent_column, condition, provenance): all declared facts.

    From enabled generic tests, native constraints (a primary key is unique and not null), and unique keys of
    incremental models whose effective strategy leaves one row per key. model and parent are names of relations.
    """
    nodes = read_nodes(spark, path)
    names = nodes.select("uid", F.col("name").alias("model"))
    tests = read_tests(spark, path).where("enabled")
    kind = F.when(F.col("name").isin("unique", "not_null", "accepted_values", "relationships"), F.col("name")).when(F.col("name").endswith("unique_combination_of_columns"), "unique")
    columns = F.when(F.col("columns").isNotNull(), F.transform("columns", F.lower)).otherwise(F.array("column_name"))
    parents = names.select(F.col("uid").alias("parent"), F.col("model").alias("parent_name"))
    a = tests.select(F.col("target").alias("uid"), kind.alias("property"), columns.alias("columns"), "accepted", "parent", "parent_column", "condition", F.lit("test").alias("provenance"))
    a = a.where("property is not null").join(parents, "parent", "left").withColumn("parent", F.col("parent_name")).drop("parent_name")
    native = read_constraints(spark, path).withColumn("property", F.explode(F.when(F.col("type") == "primary_key", F.array(F.lit("unique"), F.lit("not_null"))).when(F.col("type") == "unique", F.array(F.lit("unique"))).when(F.col("type") == "not_null", F.array(F.lit("not_null")))))
    native = native.select("uid", "property", "columns", F.lit("constraint").alias("provenance"))
    loaded = nodes.where((F.col("materialized") == "incremental") & (F.size("unique_key") > 0) & deduplicates(effective(F.col("strategy"), default_strategy)))
    loaded = loaded.select("uid", F.lit("unique").alias("property"), F.transform("unique_key", F.lower).alias("columns"), F.lit("incremental").alias("provenance"))
    out = a.unionByName(native, allowMissingColumns=True).unionByName(loaded, allowMissingColumns=True)
    return out.join(names, "uid").select("model", "property", "columns", "accepted", "parent", "parent_column", "condition", "provenance")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """edges(to_node, from_node)."""
    return read_nodes(spark, path).select(F.col("uid").alias("to_node"), F.explode("depends_on").alias("from_node"))


def declared_keys(tests: DataFrame) -> DataFrame:
    """keys(target, columns, condition): from enabled uniqueness tests; a condition limits the claim to its rows."""
    single = F.when(F.col("name") == "unique", F.array("column_name"))
    joint = F.when(F.col("name").endswith("unique_combination_of_columns"), F.transform("columns", F.lower))
    return tests.where("enabled").select("target", F.coalesce(single, joint).alias("columns"), "condition").where("columns is not null")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV seed with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=schema)


def register_models(spark: SparkSession, nodes: DataFrame, order: DataFrame) -> list[tuple[str, str]]:
    """Create a temporary view for each compiled model, dependencies first; (model, reason) of those that failed.

    A project has few models, so their names and texts are read by the driver. `order` is levels() of the edges.
    """
    skipped = []
    for r in nodes.join(order.withColumnRenamed("node", "uid"), "uid", "left").where("kind = 'model'").orderBy(F.coalesce("level", F.lit(0)), "uid").select("name", "sql").collect():
        try:
            spark.sql(r["sql"]).createOrReplaceTempView(r["name"])
        except Exception as e:
            skipped.append((r["name"], str(e).splitlines()[0]))
    return skipped
