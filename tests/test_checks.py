"""Declared against found: surrogates, documented columns, shown keys, pages, coverage, bases of lineage."""

import random

import pytest
from pyspark.sql import functions as F

from rowproof.functions import surrogate_key
from rowproof.operators import facts, ordering
from rowproof.plans import findings, lineage, schemas, surrogates

FACT = "model string, property string, columns array<string>, accepted array<string>, parent string, parent_column string, condition string, provenance string"


@pytest.fixture
def keyed(spark):
    rows = [(i, i % 7 if i % 11 else None, f"n{i % 5}", [i]) for i in range(200)]
    return spark.createDataFrame(rows, "id int, `a.b` int, c string, list array<int>")


def one(found):
    return [(r.inputs, r.hash, r.separator, r.null_text, r.n_rows, r.mismatches) for r in found.collect()]


def test_spellings_are_recognised(keyed):
    pair = keyed.select("*", surrogate_key("c", "`a.b`").alias("k"))
    assert one(surrogates.recognised(pair, "k")) == [(["c", "a.b"], "md5", "-", "_null_", 200, 0)]
    left_out = keyed.select("*", F.upper(F.sha1(F.concat_ws("|", "id", "`a.b`"))).alias("k"))
    assert one(surrogates.recognised(left_out, "K")) == [(["id", "a.b"], "sha1", "|", None, 200, 0)]
    single = keyed.select("*", F.when(F.col("id") > 20, F.sha2(F.col("id").cast("string"), 512)).alias("k"))
    assert one(surrogates.recognised(single, "k")) == [(["id"], "sha512", "", "_null_", 179, 0)]
    assert one(surrogates.recognised(pair, "k", most=1)) == [] and one(surrogates.recognised(pair, "k", ["id", "c"])) == []


def test_what_fails_beyond_the_first_rows_is_counted(keyed):
    x = keyed.coalesce(1).orderBy("id").select("*", F.when(F.col("id") < 150, surrogate_key("id", "c")).otherwise(F.md5(F.lit("x"))).alias("k"))
    assert one(surrogates.recognised(x, "k", rows=10)) == [(["id", "c"], "md5", "-", "_null_", 200, 50)]
    assert one(surrogates.recognised(keyed, "c")) == [] and one(surrogates.recognised(keyed, "id")) == []
    assert one(surrogates.recognised(x.limit(0), "k")) == [] and one(surrogates.recognised(x.withColumn("k", F.lit(None).cast("string")), "k")) == []


def test_inputs_become_facts(spark, keyed):
    x = keyed.select("*", surrogate_key("id", "c").alias("k"), F.lit("p").alias("part"))
    rows = [("t", "unique", ["part", "K"], "id > 3"), ("t", "unique", ["id"], None), ("t", "not_null", ["k"], None), ("t", "unique", ["gone"], None), ("u", "unique", ["k"], None), ("t", "unique", None, None)]
    declared = spark.createDataFrame([(m, p, c, None, None, None, w, "test") for m, p, c, w in rows], FACT)
    out = surrogates.add_inputs(declared, {"t": x}.get)
    new = [(r.model, r.columns, r.condition) for r in out.collect() if r.provenance == "surrogate"]
    assert new == [("t", ["part", "id", "c"], "id > 3")] and out.count() == len(rows) + 1
    assert surrogates.add_inputs(declared.limit(0), {"t": x}.get).count() == 0


def test_documented_columns(spark):
    t = spark.createDataFrame([("7", 1.5, 3_000_000_000, True), ("007", 2.0, 5, None), (None, None, None, None)], "s string, d double, n bigint, `o.k` boolean")
    documented = [("t", "S", "INT"), ("t", "d", "float64"), ("t", "n", "int4"), ("t", "o.k", "date"), ("t", "gone", "int"), ("t", "x", "shape"), ("u", "a", None)]
    got = schemas.compare(spark.createDataFrame(documented, "model string, name string, data_type string"), {"t": t}.get).collect()
    assert {(r.model, r.column_name, r.kind, r.unfit) for r in got} == {
        ("t", "s", "type_differs", 1), ("t", "n", "type_differs", 1), ("t", "o.k", "type_differs", None), ("t", "gone", "missing_column", None), ("t", "x", "missing_column", None), ("u", None, "missing_relation", None),
    }
    assert [str(schemas.parsed_type(x)) for x in ("character varying", "NUMERIC(10, 2)", "varchar(20)", "no type", "", None)] == ["StringType()", "DecimalType(10,2)", "StringType()", "None", "None", "None"]
    assert schemas.compare(spark.createDataFrame([], "model string, name string, data_type string"), {}.get).count() == 0


def test_hidden_group_keys(spark):
    x = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a"), (None, "b"), (2, "a")], "k int, v string")
    keys = {"k": F.col("k"), "v": F.upper("v")}
    assert sorted((str(r.k), r.n_groups) for r in facts.hidden_group_keys(x, keys, ["k"]).collect()) == [("1", 2), ("None", 2)]
    assert facts.hidden_group_keys(x, keys, ["k", "v"]).count() == 0
    assert [r.n_groups for r in facts.hidden_group_keys(x, keys, []).collect()] == [5] and facts.hidden_group_keys(x.limit(0), keys, ["k"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pages_equal_sorted_rows(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, *range(rng.choice([3, 40]))]) for _ in range(rng.choice([1, 90, 200]))]
    pages = {}
    for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v))):
        pages.setdefault(v, []).append(i // 7)
    expected = {(v, len(p), p[0], p[-1]) for v, p in pages.items() if p[0] < p[-1]}
    assert {tuple(r) for r in ordering.page_ties(spark.createDataFrame([(v,) for v in values], "v int"), "v", 7).collect()} == expected
    assert ordering.page_ties(spark.createDataFrame([], "v int"), "v", 7).count() == 0


def test_coverage_by_property(spark):
    rows = [("a", "unique", "checked"), ("a", "unique", "no columns"), ("b", "not_null", "checked"), ("c", "unique", "no such relation"), ("d", "unique", "x"), ("d", "not_null", "x")]
    x = spark.createDataFrame(rows, "model string, property string, status string")
    assert {tuple(r) for r in findings.grounding(x).collect()} == {("unique", 4, 1), ("not_null", 2, 1)}
    assert [r.model for r in findings.least_covered(x, 3).collect()] == ["d", "c", "a"]


@pytest.mark.parametrize("seed", range(3))
def test_bases_equal_closure(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(12), rng.randrange(15)) for _ in range(14)} | {(20, 21), (21, 20), (21, 20)}
    df = spark.createDataFrame(sorted(edges), "to_node int, from_node int")
    derived = {t for t, _ in edges}
    expected = {(r.node, r.ancestor) for r in lineage.closure(df).collect() if r.ancestor not in derived}
    assert {(r.node, r.base) for r in lineage.base_columns(df).collect()} == expected
