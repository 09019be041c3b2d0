"""Inequalities, nested JSON, units and permuted aggregates against plain Python."""

import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowproof.functions import units
from rowproof.operators import aggregates, inequality, joins, json_paths, permutation
from rowproof.plans import lineage
from rowproof.streaming import drain


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_below_equals_pairs(spark, parts):
    rng = random.Random(parts)
    left = [(rng.choice([None, *range(20)]),) for _ in range(80)]
    right = [(rng.choice([None, 7, 7, 7, *range(-3, 25)]),) for _ in range(90)]
    l, r = spark.createDataFrame(left, "v int"), spark.createDataFrame(right, "w int").repartition(3)
    for strict in (True, False):
        got = {x.value: (x.n_left, x.n_below) for x in inequality.below(l, "v", r, "w", strict, parts).collect()}
        less = lambda w, v: w is not None and (w < v if strict else w <= v)  # noqa: B023, E731
        assert got == {v: (left.count((v,)), sum(less(w, v) for (w,) in right)) for (v,) in left if v is not None}
    assert inequality.below(l.limit(0), "v", r, "w").count() == 0
    assert {x.n_below for x in inequality.below(l, "v", r.limit(0), "w").collect()} == {0}


def test_overlaps_equal_pairs(spark):
    rng = random.Random(1)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    make = lambda n: [(day(a), None if rng.random() < 0.1 else day(a + rng.randrange(-2, 9))) for a in (rng.randrange(30) for _ in range(n))]
    a, b = make(60), make(70)
    got = {(r.s, r.e): (r.n_left, r.n_overlaps) for r in inequality.overlaps(spark.createDataFrame(a, "s date, e date"), spark.createDataFrame(b, "s date, e date"), "s", "e", parts=6).collect()}
    valid = lambda x: x[1] is not None and x[0] <= x[1]
    assert got == {x: (a.count(x), sum(valid(x) and valid(y) and y[0] <= x[1] and y[1] >= x[0] for y in b)) for x in a}


def test_inequalities_read_rows_once(spark, monkeypatch):
    """Rows that stand for many, more ranges for more values, and results that no longer read the tables."""
    monkeypatch.setattr(inequality, "VALUES", 5)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def read(i):
        seen.add(1)
        return i // 2

    df = spark.range(1000).select(read("id").alias("v"))
    got = inequality.below(df, "v", spark.createDataFrame([(3, 2), (499, 5), (None, 1)], "w int, n long"), "w", parts=2, right_rows="n")
    read_once = seen.value
    assert got.count() == 500 and {(r.value, r.n_left, r.n_below) for r in got.where("value in (3, 4, 499)").collect()} == {(3, 2, 0), (4, 2, 2), (499, 2, 2)}
    assert 0 < seen.value == read_once


def test_json_paths(spark):
    docs = ['{"a": {"b": [1, {"c": null}, [2.5, "x"]]}, "d.e": 1}', '{"a": {"b": []}, "x y": true}', '{"a": 5}', "[1, 2]", "oops {", None, "null", '"text"', json.dumps({"l": {"m": {"n": {"o": {"p": [{"q": 1}, {"q": "r"}, {}]}}}}})]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = {r.path: (r.types, r.n_values, r.n_rows, r.optional, r.mixed) for r in json_paths.profile(df, "id", "doc").collect()}
    assert got["$"] == (["array", "invalid", "null", "object", "string"], 8, 8, False, True)
    assert got["$.a"] == (["integer", "object"], 3, 3, True, True)
    assert got["$.a.b"] == (["array"], 2, 2, False, False) and got["$.a.b[*]"] == (["array", "integer", "object"], 3, 1, False, True)
    assert got["$.a.b[*].c"] == (["null"], 1, 1, False, False) and got["$.a.b[*][*]"] == (["number", "string"], 2, 1, False, True)
    assert got['$[["d.e"]]'][:2] == (["integer"], 1) and got['$[["x y"]]'] == (["boolean"], 1, 1, True, False)
    assert got["$.l.m.n.o.p[*].q"] == (["integer", "string"], 2, 1, True, True) and got["$[*]"] == (["integer"], 2, 1, False, False)
    assert json_paths.profile(df.limit(0), "id", "doc").count() == 0


def test_units(spark):
    df = spark.createDataFrame([("x", 2.0, {"usd": 1, "piece": -1}, 3.0), ("x", 4.0, {"piece": -1, "usd": 1}, 1.0), ("y", 1.0, {"usd": 1}, 1.0), ("y", 1.0, {"eur": 1}, 1.0), ("z", 1.0, None, 1.0), ("z", 1.0, {}, 1.0)], "k string, v double, u map<string,int>, q double")
    text = lambda c: [r[0] for r in df.select(units.written(c)).collect()]
    assert text(F.col("u")) == ["piece^-1*usd", "piece^-1*usd", "usd", "eur", None, "1"]
    assert text(units.times(F.col("u"), units.unit(piece=1))) == ["usd", "usd", "piece*usd", "eur*piece", None, "piece"]
    assert text(units.over(F.col("u"), F.col("u"))) == ["1", "1", "1", "1", None, "1"]
    assert [r[0] for r in df.select(units.agree(F.col("u"), units.unit(usd=1))).collect()] == [False, False, True, False, False, False]
    got = {r.k: (r.total, r.unit, r.units, r.unknown) for r in units.sums(df, ["k"], F.col("v") * F.col("q"), units.times(F.col("u"), units.unit(piece=1))).collect()}
    assert got == {"x": (10.0, "usd", 1, 0), "y": (None, None, 2, 0), "z": (None, None, 1, 1)}


def test_units_of_gathered_rows(spark):
    df = spark.createDataFrame([("x", 2.0, "usd"), ("x", 4.5, "usd"), ("y", 1.0, "usd"), ("y", 1.0, "eur"), ("y", 1.0, "eur"), ("z", 1.0, None), ("z", 1.0, None), ("z", 1.0, "usd")], "k string, v double, c string")
    of = F.when(F.col("c").isNotNull(), F.create_map(F.col("c"), F.lit(1)))
    got = units.gathered(df, ["k"], ["c"], {"v": "v"}, 2)
    assert sorted((r.k, str(r.c), float(r.v), r.rows) for r in got.collect()) == [("x", "usd", 6.5, 2), ("y", "eur", 2.0, 2), ("y", "usd", 1.0, 1), ("z", "None", 2.0, 2), ("z", "usd", 1.0, 1)]
    sums = {r.k: tuple(r)[1:] for r in units.sums(got, ["k"], "v", of, 2, rows="rows").collect()}
    assert sums == {r.k: tuple(r)[1:] for r in units.sums(df, ["k"], "v", of, 2).collect()} == {"x": (6.5, "usd", 1, 0), "y": (None, None, 2, 0), "z": (None, None, 1, 2)}
    only = units.sums(got.where(units.agree(of, units.unit(usd=1))), ["k"], "v", of, 2, rows="rows")
    assert {r.k: r.total for r in only.collect()} == {"x": 6.5, "y": 1.0, "z": 1.0}


def test_permuted_aggregates(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 1000 - 500) for i in range(900)], "at long, v long").repartition(5)

    @F.pandas_udf("long")
    def third(s: pd.Series) -> int:
        return int(s.iloc[2])

    @F.pandas_udf("long")
    def mean(s: pd.Series) -> int:
        return int(s.sum() // len(s))

    out = permutation.dependence(df, "at", {"first": F.first("v"), "last": F.last("v"), "min": F.min("v"), "sum": F.sum("v"), "list": F.collect_list("v"), "set": F.array_sort(F.collect_set("v")), "first_by": F.min_by("v", "at")}, {"third": third("v"), "mean": mean("v")}, {"count_distinct": F.count_distinct("v")}, block=90)
    got = {r.aggregate: (r.by_order > 0, r.by_duplicates > 0, r.by_parts > 0) for r in out.collect()}
    o, d = (True, False, True), (False, True, False)
    none, both = (False, False, False), (True, True, True)
    assert got == {"first": o, "last": o, "min": none, "sum": d, "list": both, "set": none, "first_by": none, "third": both, "mean": d, "count_distinct": none}
    assert {r.blocks for r in out.collect()} == {10}


def test_permuted_rows_stay_in_order_with_many_groups_and_ties(spark):
    """Neither more groups than an aggregate holds in memory nor ties of the order let a list depend on how rows arrive."""
    df = spark.createDataFrame([(i // 3, (i * 7919) % 1000) for i in range(3000)], "at long, v long").repartition(5)
    rows = permutation.variants(df, "at", block=10).groupBy("block", "variant").agg(F.collect_list(F.struct("part", "place", "v")).alias("held")).collect()
    assert len(rows) > 1000 and all(r.held == sorted(r.held) for r in rows)


def test_small_operators(spark):
    a = spark.createDataFrame([(1, 2, "p"), (2, 2, "q"), (None, 1, "r")], "k int, x int, name string")
    b = spark.createDataFrame([(1, 1, "s"), (2, 9, "t")], "k int, y int, name string")
    got = sorted((r.left.name, r.right.name) for r in joins.either(a, b, ("k", "k"), ("x", "k")).collect())
    assert got == [("p", "s"), ("p", "t"), ("q", "t"), ("r", "s")]
    with pytest.raises(ValueError, match="cycle"):
        lineage.levels(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "to_node string, from_node string"))
    x = spark.createDataFrame([("g", 1, "u"), ("g", 2, "v"), ("g", 2, "v"), ("h", 1, "u"), (None, 3, "u"), (None, 4, "w"), ("i", 5, "u"), ("i", 5, "v")], "g string, d int, u string")
    assert sorted(map(str, (tuple(r) for r in aggregates.discharged_by_dependency(x, ["g"], "d", "u").collect()))) == sorted(map(str, [("g", 2, 2), (None, 2, 2)]))


def test_empty_stream(spark, tmp_path):
    schema = "k int"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert drain(stream).count() == 0 and drain(stream.groupBy("k").count(), "complete").columns == ["k", "count"]
