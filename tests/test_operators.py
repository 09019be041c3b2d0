import json

import pytest
from pyspark.sql import functions as F

from rowproof import sources
from rowproof.operators import aggregates, arrays, facts, joins, ordering
from rowproof.operators.contracts import Agg, compare, grain, refers, rows_that_break, violations
from rowproof.plans import findings, incremental, lineage, project, replay
from rowproof.streaming import drain, first_rows, read_files


def test_facts_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None), (2, None)], "k int, v string")
    assert [tuple(r) for r in facts.key_violations(df, ["k"]).orderBy("k").collect()] == [(1, 2), (2, 2)]
    assert facts.key_violations(df, ["k"], F.col("v") == "a").count() == 0
    assert {r.k for r in facts.fd_violations(df, ["k"], "v").collect()} == {1}
    assert [tuple(r) for r in facts.null_violations(df, ["k", "v"]).collect()] == [("k", 2), ("v", 2)]
    assert facts.orphans(df, df.where("k = 1"), "k", "k").count() == 2
    assert facts.counterexamples(df, F.lit(True), F.col("k") == 1).count() == 4


def test_key_is_kept_or_lost_by_joins(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    b = spark.createDataFrame([(1,), (1,), (3,)], "j int")
    joined = a.join(b, a.k == b.j, "left")
    assert facts.key_violations(joined, ["k"]).count() == 1  # j is no key, so k is none after the join
    unique = a.join(b.distinct(), a.k == F.col("j"), "left")
    assert facts.key_violations(unique, ["k"]).count() == 0
    assert {(r.matches, r.left_rows) for r in joins.fanout(a, b, "k", "j").collect()} == {(2, 1), (0, 1)}


def test_not_in_over_nothing_and_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    pick = lambda rows: tuple(joins.not_in_trap(a, spark.createDataFrame(rows, "j int"), "k", "j").first())
    assert pick([]) == (3, 3)
    assert pick([(1,)]) == (1, 2)
    assert pick([(1,), (None,)]) == (0, 2)


def test_sentinel_pairs_equal_a_plain_join(spark):
    a = spark.createDataFrame([(1,), (None,), (None,), (-1,)], "a int")
    b = spark.createDataFrame([(-1,), (None,), (1,)], "b int")
    plain = a.join(b, F.coalesce("a", F.lit(-1)) == F.coalesce("b", F.lit(-1))).where("(a = b) is null").count()
    assert sum(r.false_matches for r in joins.sentinel_matches(a, b, "a", "b", -1).collect()) == plain


def test_ties(spark):
    df = spark.createDataFrame([("x", 3), ("x", 2), ("x", 2), ("y", 1), ("y", 0)], "g string, v int")
    assert [tuple(r) for r in ordering.top_n_ties(df, ["g"], "v", 2).collect()] == [("x", 3)]
    assert [tuple(r) for r in ordering.cutoff_ties(df, "v", 3).collect()] == [(2, 2, 1)]
    assert ordering.cutoff_ties(df, "v", 4).count() == 0


def test_flatten(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, a array<int>")
    assert {r.id for r in arrays.dropped_parents(df, F.col("a")).collect()} == {2, 3}
    assert tuple(arrays.flatten_counts(df, F.col("a")).first()) == (3, 2, 4)
    assert df.select(F.explode("a")).count() == 2 and df.select(F.explode_outer("a")).count() == 4


def test_registry_agrees_with_data(spark):
    """An aggregate that is said not to see duplicates must not change; one that does must change here."""
    df = spark.createDataFrame([(i, 2**i, i % 2 == 1) for i in range(6)], "q int, k int, b boolean")
    make = {
        "sum": F.sum("q"), "avg": F.avg("q"), "min": F.min("q"), "max": F.max("q"), "count": F.count("q"), "count_if": F.count_if("b"), "bool_and": F.bool_and("b").cast("int"), "bool_or": F.bool_or("b").cast("int"),
        "bit_and": F.bit_and("k"), "bit_or": F.bit_or("k"), "bit_xor": F.bit_xor("k"), "stddev_pop": F.stddev_pop("q"), "var_pop": F.var_pop("q"), "median": F.median("q"), "min_by": F.min_by("k", "q"), "max_by": F.max_by("k", "q"),
        "mode": F.mode("q", True), "stddev": F.stddev("q"), "variance": F.variance("q"), "percentile": F.percentile("q", 0.9), "percentile_approx": F.percentile_approx("q", 0.5), "percentile_cont": F.expr("percentile_cont(0.5) within group (order by q)"),
        "percentile_disc": F.expr("percentile_disc(0.5) within group (order by q)"), "any_value": F.any_value(F.lit(7)), "first": F.first("q"), "last": F.last("q"), "listagg": F.length(F.listagg(F.col("q").cast("string"), F.lit(","))), "approx_count_distinct": F.approx_count_distinct("q"), "kurtosis": F.kurtosis("q"), "skewness": F.skewness("q"), "collect_list": F.size(F.collect_list("q")),
    }
    for r in aggregates.duplication_effect(df, make, F.when(F.col("q") == 5, 4).otherwise(1)).collect():
        assert (abs(r.base - r.duplicated) > 1e-9) == aggregates.duplicate_sensitive(r.aggregate), r
    assert aggregates.duplicate_sensitive("unheard_of") and not aggregates.duplicate_sensitive("sum", distinct=True)


def test_aggregates_that_keep_every_value_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "BLOCK", 3)
    strings, sizes = F.length(F.listagg("v", F.lit(","))), F.size(F.collect_list("v"))
    held = {"listagg": (strings, lambda n: F.sum(n) + F.count(n) - 1), "collect_list": (sizes, F.sum)}
    values = ["a", "bc", None, "def", "", None, None, None, None, "g"] * 4
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int").repartition(3)
    repeat = 1 + F.col("i") % 3
    got = {r.aggregate: (r.base, r.duplicated) for r in aggregates.duplication_effect(df, {"count": F.count("*")}, repeat, held).collect()}
    more = [v for i, v in enumerate(values) for _ in range(1 + i % 3)]
    known = [[v for v in x if v is not None] for x in (values, more)]
    assert got["count"] == (len(values), len(more))
    assert got["collect_list"] == tuple(len(x) for x in known)
    assert got["listagg"] == tuple(len(",".join(x)) for x in known)


def test_exact_percentiles(spark):
    rows = [("a", float(i * 7 % 5000)) for i in range(5000)] + [("b", 1.0)] * 9 + [("b", 2.0), ("b", None), (None, 4.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    df.createOrReplaceTempView("percentiles")
    for p in (0.0, 0.001, 0.3, 0.5, 0.95, 1.0):
        want = spark.sql(f"select k, percentile_disc({p}D) within group (order by v) as x from percentiles group by k").collect()
        got = {r.k: r.percentile for r in ordering.exact_percentiles(df, ["k"], "v", p).collect()}
        assert got == {r.k: r.x for r in want if r.x is not None}, p


def test_contracts(spark):
    own = spark.createDataFrame([("a", 600.0), ("a", 400.0), ("b", 10.0)], "k string, amount double")
    other = spark.createDataFrame([("a", 1020.0), ("b", 12.0)], "k string, amount double")
    left, right = Agg("sum", "amount").of(own).by("k"), Agg("sum", "amount").of(other).by("k")
    assert {r.k for r in violations(left, right).collect()} == {"a", "b"}
    assert {r.k for r in violations(left, right, relative=0.05).collect()} == {"b"}
    assert violations(left, right, "<=").count() == 0 and violations(left, left).count() == 0
    assert {r.k for r in violations(left, Agg("sum", "amount").of(other.where("k = 'a'")).by("k"), within=1e6).collect()} == {"b"}
    doubled = Agg("sum", "amount").of(own.union(own)).by("k")
    assert {r.k for r in violations(left, doubled).collect()} == {"a", "b"}
    whole = compare(Agg("sum", "amount").of(own), Agg("sum", "amount").of(other), "<").first()
    assert (whole.left_value, whole.right_value, whole.holds) == (1010.0, 1032.0, True)
    nulls = spark.createDataFrame([(None, 1.0)], "k string, amount double")
    assert violations(Agg("sum", "amount").of(nulls).by("k"), Agg("sum", "amount").of(nulls).by("k")).count() == 0


def test_contracts_of_expressions_and_fractions(spark):
    rows = spark.createDataFrame([("a", 0.004, 1)] * 100 + [("b", 1.0, 3), ("b", 2.0, None)], "k string, price double, n int")
    right = spark.createDataFrame([("a", 0.4), ("b", 3.0)], "k string, due double")
    left = Agg("sum", F.col("price") * F.col("n")).of(rows).by("k")
    assert violations(left, Agg("sum", "due").of(right).by("k"), within=1e-9).count() == 0
    assert [(r.k, r.left_value) for r in violations(Agg("sum", "price", scale=2).of(rows).by("k"), Agg("sum", "due").of(right).by("k"), within=1e-9).collect()] == [("a", 0.0)]
    exact = spark.sql("select 'a' as k, 0.0001 as price union all select 'a', 0.0002")
    assert Agg("sum", "price").of(exact).by("k").value().first()[1] == 0.0003
    some = Agg("avg", "price").of(rows).where(F.col("price").between(0.5, 5) & ~F.col("n").isNull())
    assert some.value().first()[0] == 1.0
    assert {r.k for r in grain(rows, "k").collect()} == {"a", "b"} and refers(rows, "k", right.where("k = 'a'"), "k").count() == 2
    assert rows_that_break(rows, F.col("n") * 2 < 6).count() == 1


def test_surrogates(spark):
    df = spark.createDataFrame([("a-b", "c"), ("a", "b-c"), (None, "x"), ("_null_", "x"), ("q", "r"), ("q", "r"), ("a\\", "-b"), ("a", "\\-b")], "x string, y string")
    got = sorted((r.n, r.n_inputs) for r in facts.surrogate_violations(df, ["x", "y"]).collect())
    assert got == [(2, 1), (2, 2), (2, 2)]
    assert [(r.n, r.n_inputs) for r in facts.surrogate_violations(df, ["x", "y"], escaped=True).collect()] == [(2, 1)]


def test_joins_by_two_keys_and_padding(spark):
    a = spark.createDataFrame([(1, 2), (2, 2), (3, None), (None, 9)], "x int, y int")
    b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    got = sorted(str(tuple(r)) for r in joins.either(a, b, ("x", "k"), ("y", "k")).select("left.*", "right.*").collect())
    a.createOrReplaceTempView("ta")
    b.createOrReplaceTempView("tb")
    assert got == sorted(str(tuple(r)) for r in spark.sql("select * from ta join tb on x = k or y = k").collect())
    assert {r.k for r in joins.right_padding(a.where("x = 1"), b, F.col("x") == F.col("k")).collect()} == {2, None}
    known = spark.createDataFrame([(1, None), (2, "v")], "k int, v string")
    lost = joins.null_group(a, known, F.col("x") == F.col("k"), "v", "x").collect()
    assert [tuple(r) for r in lost] == [(None, 2, 3.0)]  # the partner's own NULL is no padding


def test_effective_strategy_and_replay(spark):
    df = spark.createDataFrame([("Merge ",), ("custom_macro",), (None,), ("append",)], "s string")
    got = [tuple(r) for r in df.select("s", incremental.effective(F.col("s"), "delete+insert").alias("e")).withColumn("one", incremental.deduplicates(F.col("e"))).collect()]
    assert got == [("Merge ", "merge", True), ("custom_macro", None, False), (None, "delete+insert", True), ("append", "append", False)]
    assert tuple(replay.differences(lambda: df).first()) == (0, 0)
    assert tuple(replay.differences(lambda: df.withColumn("u", F.expr("uuid()"))).first()) == (4, 4)
    assert tuple(replay.differences(lambda: df.limit(0)).first()) == (0, 0)


def test_replays_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(replay, "ROWS", 100)
    for n in (500, 5000):
        make = lambda n=n: spark.range(n).select((F.col("id") % 400).alias("k"))
        assert replay._counted(make).rdd.getNumPartitions() == 2 * n // 100
        assert tuple(replay.differences(make).first()) == (0, 0)
    assert tuple(replay.differences(lambda: spark.range(700).select(F.expr("uuid()").alias("u"))).first()) == (700, 700)


def test_project_to_findings(spark, tmp_path):
    project_ = {
        "nodes": {
            "model.p.orders": {"name": "orders", "resource_type": "model", "config": {"materialized": "incremental", "unique_key": ["ID"], "incremental_strategy": "merge"}, "columns": {"id": {"constraints": [{"type": "not_null"}]}}, "constraints": [{"type": "primary_key", "columns": ["id", "Line"]}]},
            "model.p.log": {"name": "log", "resource_type": "model", "config": {"materialized": "incremental", "unique_key": "id", "incremental_strategy": "append"}},
            "model.p.customers": {"name": "customers", "resource_type": "model", "config": {}},
            "test.p.r": {"resource_type": "test", "attached_node": "model.p.orders", "column_name": "customer", "config": {}, "depends_on": {"nodes": ["model.p.customers", "model.p.orders"]}, "test_metadata": {"name": "relationships", "kwargs": {"to": "ref('customers')", "field": "ID"}}},
            "test.p.a": {"resource_type": "test", "attached_node": "model.p.orders", "column_name": "status", "config": {"where": "id > 1"}, "test_metadata": {"name": "accepted_values", "kwargs": {"values": ["open", "sent"]}}},
            "test.p.n": {"resource_type": "test", "attached_node": "model.p.customers", "column_name": "email", "config": {}, "test_metadata": {"name": "not_null", "kwargs": {}}},
            "test.p.off": {"resource_type": "test", "attached_node": "model.p.customers", "column_name": "id", "config": {"enabled": False}, "test_metadata": {"name": "unique", "kwargs": {}}},
        },
        "sources": {},
    }
    path = str(tmp_path / "project.json")
    with open(path, "w") as f:
        json.dump(project_, f)
    tables = {
        "orders": spark.createDataFrame([(1, 1, 7, "odd"), (2, 1, 8, "lost"), (2, 1, 9, "open"), (None, 2, 7, "sent")], "id int, line int, customer int, status string"),
        "customers": spark.createDataFrame([(7,), (8,)], "id int"),
    }
    declared = sources.read_facts(spark, path)
    assert {(r.model, r.property, tuple(r.columns), r.provenance) for r in declared.collect()} == {
        ("orders", "not_null", ("id",), "constraint"), ("orders", "unique", ("id", "line"), "constraint"), ("orders", "not_null", ("id", "line"), "constraint"), ("orders", "unique", ("id",), "incremental"),
        ("orders", "relationships", ("customer",), "test"), ("orders", "accepted_values", ("status",), "test"), ("customers", "not_null", ("email",), "test"),
    }
    found, coverage = project.analyze(declared, tables.get, floor=0.5)
    assert {(r.property, r.column_name, r.broken) for r in found.collect()} == {("not_null", "id", 1), ("unique", "id,line", 1), ("not_null", "id,line", 1), ("unique", "id", 1), ("relationships", "customer", 1), ("accepted_values", "status", 1)}
    assert {(r.model, r.declared, r.checked, r.kind) for r in coverage.collect()} == {("orders", 6, 6, None), ("customers", 1, 0, "resolution_below_floor")}
    findings.write(found, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("severity = 'error'").count() == 6
    assert project.check(declared.limit(0), tables.get).count() == 0


def test_seed_rows(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("id,name\n1,a\n2,\n")
    assert [tuple(r) for r in sources.read_rows(spark, str(tmp_path / "seed.csv"), "id int, name string").collect()] == [(1, "a"), (2, None)]


def test_cutoff_ties_with_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (2,)], "v int")
    assert [tuple(r) for r in ordering.cutoff_ties(df, "v", 1).collect()] == [(None, 2, 1)]
    assert ordering.cutoff_ties(df, "v", 2).count() == 0 and ordering.cutoff_ties(df, "v", 9).count() == 0


def test_findings(spark):
    schema = "family string, kind string, model string, column_name string, world string"
    f = spark.createDataFrame([("a", "join_on_nullable_key", "m", None, w) for w in ("full", "steady")] + [("a", "join_fanout", "m", None, "full")], schema)
    assert [(r.kind, r.worlds) for r in findings.only_in_some_worlds(f, ["full", "steady"]).collect()] == [("join_fanout", ["full"])]
    assert findings.introduced(f, f).count() == 0
    assert {r.kind for r in findings.introduced(f, f.where("world = 'steady'")).collect()} == {"join_fanout"}
    assert tuple(findings.passes(f).first()) == (3, 2, False)
    assert findings.suppressed(f, spark.createDataFrame([("m", None)], "model string, kind string")).count() == 0


def test_lineage(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "c"), ("d", "x"), ("d", "x")], "to_node string, from_node string")
    assert {(r.node, r.base) for r in lineage.base_columns(e).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("d", "x")}
    assert {r.node: r.level for r in lineage.levels(e).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3}
    assert lineage.cycles(e).count() == 0
    assert {r.node for r in lineage.cycles(e.union(spark.createDataFrame([("a", "c")], e.schema))).collect()} == {"a", "b", "c"}


def test_incremental(spark):
    target = spark.createDataFrame([(1, 1, "old"), (2, 1, "old")], "k int, day int, v string")
    batch = spark.createDataFrame([(2, 2, "new"), (2, 3, "newer"), (3, 3, "new")], target.schema)
    n = lambda s, **kw: sorted(tuple(r) for r in incremental.load(target, batch, s, ["k"], [F.col("day").desc()], **kw).collect())
    assert len(n("append")) == 5
    assert n("merge") == [(1, 1, "old"), (2, 3, "newer"), (3, 3, "new")]
    assert len(n("delete+insert")) == 4 and len(n("insert_overwrite", partition="day")) == 5


def test_project_files(spark, tmp_path):
    project = {
        "nodes": {
            "model.p.stg": {"name": "stg", "resource_type": "model", "compiled_code": "select 1 as id, 2 as v", "compiled": True, "config": {"materialized": "view"}, "columns": {"ID": {"data_type": "int"}}, "depends_on": {"nodes": ["source.p.raw.t"]}},
            "model.p.mart": {"name": "mart", "resource_type": "model", "compiled_code": "select id, sum(v) as v from stg group by id", "compiled": True, "config": {"materialized": "incremental", "unique_key": "id", "incremental_strategy": "merge"}, "depends_on": {"nodes": ["model.p.stg"]}},
            "model.p.bad": {"name": "bad", "resource_type": "model", "compiled_code": "select nope from stg", "compiled": True, "config": {"materialized": "odd"}, "depends_on": {"nodes": ["model.p.mart"]}},
            "model.p.raw": {"name": "raw", "resource_type": "analysis", "config": {}},
            "test.p.u": {"name": "u", "resource_type": "test", "attached_node": "model.p.stg", "column_name": "ID", "config": {"enabled": True, "where": "v > 0"}, "test_metadata": {"name": "unique", "kwargs": {}}},
            "test.p.c": {"name": "c", "resource_type": "test", "config": {}, "depends_on": {"nodes": ["model.p.mart", "macro.x"]}, "test_metadata": {"name": "unique_combination_of_columns", "kwargs": {"combination_of_columns": ["A", "b"]}}},
        },
        "sources": {"source.p.raw.t": {"name": "t", "identifier": "t_raw", "resource_type": "source", "columns": {}}},
    }
    path = str(tmp_path / "project.json")
    with open(path, "w") as f:
        json.dump(project, f)
    nodes = {r.uid: r for r in sources.read_nodes(spark, path).collect()}
    assert len(nodes) == 7
    assert nodes["source.p.raw.t"].name == "t_raw" and nodes["model.p.raw"].kind == "other" and nodes["model.p.bad"].materialized == "other"
    assert nodes["model.p.mart"].unique_key == ["id"] and nodes["model.p.stg"].status == "compiled" and nodes["model.p.raw"].status == "not_compiled"
    assert [(r.uid, r.name, r.data_type) for r in sources.read_columns(spark, path).collect()] == [("model.p.stg", "id", "int")]
    keys = {r.target: (r.columns, r.condition) for r in sources.declared_keys(sources.read_tests(spark, path)).collect()}
    assert keys == {"model.p.stg": (["id"], "v > 0"), "model.p.mart": (["a", "b"], None)}
    order = lineage.levels(sources.read_edges(spark, path))
    skipped = sources.register_models(spark, sources.read_nodes(spark, path), order)
    assert [name for name, _ in skipped] == ["bad"]
    assert [tuple(r) for r in spark.table("mart").collect()] == [(1, 2)]


def test_project_files_of_odd_shapes(spark, tmp_path):
    def written(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    before = {t.name for t in spark.catalog.listTables()}
    assert sources.read_nodes(spark, written("none.json", "{}")).count() == 0
    odd = written("odd.json", json.dumps({"nodes": {"a": {"name": "a", "columns": [1], "constraints": None}, "b": 5, "c": None}, "sources": [], "metadata": {"nodes": {"z": {}}}}))
    assert {r.uid: r.name for r in sources.read_nodes(spark, odd).collect()} == {"a": "a", "b": None, "c": None}
    assert sources.read_columns(spark, odd).count() == 0 and sources.read_constraints(spark, odd).count() == 0
    held = written("held.json", json.dumps({"nodes": {"m": {"name": "m", "constraints": [{"type": "PRIMARY_KEY", "columns": ["A", "b"]}], "columns": {"V": {"constraints": [{"type": "not_null"}, {"type": None}]}}}}}, indent=1))
    assert sorted((r.type, r.columns) for r in sources.read_constraints(spark, held).collect()) == [("not_null", ["v"]), ("primary_key", ["a", "b"])]
    for name, text in (("cut.json", '{"nodes": {"a": {"name"'), ("list.json", "[1, 2]"), ("text.json", "nothing")):
        with pytest.raises(Exception, match="no project metadata"):
            sources.read_nodes(spark, written(name, text)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_project_file_above_one_variant(spark, tmp_path):
    sql = "select 1 as x --" + "x" * 5_000_000
    path = str(tmp_path / "large.json")
    with open(path, "w") as f:
        f.write('{"metadata": {}, "nodes": {')
        for i in range(30):
            f.write(("," if i else "") + json.dumps(f"model.p.m{i}") + ":" + json.dumps({"name": f"m{i}", "resource_type": "model", "compiled_code": sql, "compiled": True}))
        f.write("}}")
    rows = sources.read_nodes(spark, path).select("name", "kind", "status", F.length("sql").alias("n")).collect()
    assert sorted((r.name, r.kind, r.status, r.n) for r in rows) == sorted((f"m{i}", "model", "compiled", len(sql)) for i in range(30))


def test_stream_first_rows(spark):
    stream = first_rows(read_files(spark, "/root/testdata/sf0.001", "events.parquet"), "ts", ["user_id"], "400 days")
    assert drain(stream.select("user_id")).count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
