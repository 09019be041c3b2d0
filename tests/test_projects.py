"""Whole projects: join chains, worlds, facts that cannot be checked, stored state, builds."""

import random
import shutil
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rowproof.plans import conditions, dependencies, findings, fingerprints, project
from rowproof.plans.fact_state import KeyState
from rowproof.plans.join_chain import JoinChain, Step
from rowproof.plans.worlds import enumerate_worlds, facts_by_world


def built(names, frames, steps):
    """The chain's joins as lists of dicts, and the accounts they give."""
    rows, out = [{names[0]: r} for r in frames[names[0]]], []
    for name, parent, pk, k, how in steps:
        new, matched, own, before = [], 0, 0, 0
        for row in rows:
            p = row[parent]
            hits = [r for r in frames[name] if p is not None and p[pk] is not None and r[k] == p[pk]]
            matched, own, before = matched + bool(hits), own + (not hits and p is not None), before + (p is None)
            new += [row | {name: r} for r in hits] or ([row | {name: None}] if how == "left" else [])
        out.append((name, how, len(rows), matched, own, before, len(new)))
        rows = new
    return out


@pytest.mark.parametrize("seed", range(4))
def test_join_chain_equals_built_joins(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, 1, 2, 3, 4, 5])
    names = ["t0", "t1", "t2", "t3", "t4"]
    frames = {n: [{"a": key(), "b": key()} for _ in range(rng.randrange(1, 9))] for n in names}
    steps = [(n, names[rng.randrange(i + 1)], rng.choice("ab"), rng.choice("ab"), rng.choice(["left", "left", "inner"])) for i, n in enumerate(names[1:])]
    df = {n: spark.createDataFrame([(r["a"], r["b"]) for r in x], "a int, b int") for n, x in frames.items()}
    chain = JoinChain("t0", df["t0"], [Step(n, df[n], p, pk, k, how) for n, p, pk, k, how in steps])
    assert sorted(tuple(r) for r in chain.account().collect()) == sorted(built(names, frames, steps))
    causes = {}
    for r in chain.causes().collect():
        causes[r.step] = causes.get(r.step, 0) + r.n
    assert causes == {n: own + before for n, _, _, _, own, before, _ in built(names, frames, steps) if own + before}
    with pytest.raises(ValueError):
        JoinChain("t0", df["t0"], [Step("t1", df["t1"], "t2", "a", "a")])


def test_clean_worlds_count(spark):
    found = spark.createDataFrame([("full", "a"), ("full", "b"), ("steady", "b"), ("forgotten", "a")], "world string, model string")
    some = lambda worlds: {r.model: r.worlds for r in findings.only_in_some_worlds(found, worlds, ("model",)).collect()}
    assert some(["full", "steady"]) == {"a": ["full"]}
    assert some(["full", "steady", "clean"]) == {"a": ["full"], "b": ["full", "steady"]}
    assert some(["full"]) == {} and some(spark.createDataFrame([("full",), ("clean",)], "w string")) == {"a": ["full"], "b": ["full"]}


def test_worlds_share_one_scan(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "x", 5), (1, "y", 7), (None, None, 9), (None, "x", 9), (2, "x", None), (2, "x", 6)], "k int, v string, n int").write.parquet(path)
    df = spark.read.parquet(path)
    worlds = enumerate_worlds({"a": {"all": F.lit(True), "small": F.col("n") < 7}, "b": {"all": F.lit(True), "none": F.lit(False), "null": F.lit(None).cast("boolean")}})
    out = facts_by_world(df, worlds, {"k is a key": ["k"]}, {"n below 8": F.col("n") < 8}, {"k gives v": (["k"], "v")})
    got = {(r.fact, r.world): r.broken for r in out.collect()}
    assert len(got) == 18 and len(worlds) == 6
    assert got[("k is a key", "a=all,b=all")] == 2 and got[("k is a key", "a=small,b=all")] == 0
    assert got[("n below 8", "a=all,b=all")] == 2 and got[("k gives v", "a=all,b=all")] == 2 and got[("k gives v", "a=small,b=all")] == 0
    assert all(v == 0 for (_, w), v in got.items() if not w.endswith("b=all"))
    assert len(out.inputFiles()) > 0 and out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    with pytest.raises(ValueError):
        facts_by_world(df, {str(i): F.lit(True) for i in range(63)}, {"k": ["k"]})


def test_bad_facts_do_not_stop_the_others(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.5), (2, None, 9.0)], "id int, name string, price double")
    parent = spark.createDataFrame([(1,)], "A int")
    rows = [
        ("t", "unique", ["id"], None, None, None, None, "test"), ("t", "unique", ["id"], None, None, None, "no_such > 1", "test"), ("t", "not_null", ["name"], None, None, None, "price >", "test"),
        ("t", "accepted_values", ["id"], ["1", "x"], None, None, None, "test"), ("t", "accepted_values", ["price"], ["1", "2.50"], None, None, None, "test"), ("t", "accepted_values", ["name"], None, None, None, None, "test"),
        ("t", "shaped_like", ["id"], None, None, None, None, "test"), ("t", "relationships", ["ID"], None, "p", "a", None, "test"), ("t", "relationships", ["id"], None, "p", "b", None, "test"), ("t", "relationships", ["id"], None, None, None, None, "test"),
        ("t", "not_null", ["NAME"], None, None, None, "cast(name as int) > 0", "test"), ("t", "unique", [], None, None, None, None, "test"), ("u", "unique", ["id"], None, None, None, None, "test"),
    ]
    declared = spark.createDataFrame(rows, "model string, property string, columns array<string>, accepted array<string>, parent string, parent_column string, condition string, provenance string")
    checked = project.check(declared, {"t": t, "p": parent}.get)
    got = sorted((r.model, r.property, r.column_name, r.status, r.broken) for r in checked.collect())
    status = {s for *_, s, _ in got}
    assert len(got) == len(rows)
    assert ("t", "unique", "id", "checked", 1) in got and ("t", "accepted_values", "id", "checked", 1) in got and ("t", "accepted_values", "price", "checked", 1) in got and ("t", "accepted_values", "name", "checked", 2) in got
    assert ("t", "relationships", "ID", "checked", 2) in got and [s for *_, s, _ in got].count("no such parent") == 2
    assert {"unknown property shaped_like", "no such relation", "no columns"} <= status
    assert any(s.startswith("does not resolve: unresolved column") for s in status) and any(s.startswith("does not resolve: parse") for s in status)
    assert ("t", "not_null", "NAME", "fails: cast invalid input", None) in got
    assert all(b is None for *_, s, b in got if s != "checked")
    assert project.check(declared.limit(0), lambda name: None).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_dependencies_equal_exhaustive_search(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(30):
        a, b = rng.randrange(6), rng.choice([None, 1, 2])
        rows.append((a, b, a % 2, (a * 3 + (b or 0)) % 5, 7, i if seed else rng.randrange(20)))
    names = list("abcdef")
    size = lambda s: len({tuple(r[names.index(c)] for c in sorted(s)) for r in rows})
    sets = [frozenset(s) for k in range(4) for s in combinations(names, k)]
    keys = [s for s in sets if s and size(s) == len(rows) and not any(size(s - {c}) == len(rows) for c in s)]
    gives = lambda s, a: size(s | {a}) == size(s)
    wanted = [(s, a) for s in sets if len(s) < 3 and size(s) < len(rows) for a in names if a not in s and gives(s, a) and not any(gives(s - {c}, a) for c in s)]
    found = dependencies.Found(spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int"), names, 3)
    assert set(found.dependencies) == set(wanted) and set(found.keys) == set(keys)
    assert sum(map(len, found.counted)) < len(sets) - 1  # pruned
    cover = dependencies.minimal_cover(found.dependencies)
    assert all(a in dependencies.closure(x, cover) for x, a in found.dependencies)
    assert all(d[1] not in dependencies.closure(d[0], [e for e in cover if e != d]) for d in cover)
    empty = dependencies.Found(spark.createDataFrame([], "a int, b int"), ["a", "b"])
    assert not empty.keys and not empty.dependencies


def test_dependencies_of_a_large_table_are_confirmed_on_all_rows(spark, monkeypatch):
    """Witnesses refute most sets; a fact that only rows beyond them break is no fact."""
    monkeypatch.setattr(dependencies, "WITNESSES", 40)
    rows = [(i, i % 50, i % 10 if i != 333 else 99, i % 7 if i % 3 else None, "k" if i != 512 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, `e.f` string").withColumnRenamed("e.f", "e")
    found = dependencies.Found(df, list("abcde"), 3)
    value = lambda s: [tuple(r["abcde".index(c)] for c in sorted(s)) for r in rows]
    size = lambda s: len(set(value(s)))
    sets = [frozenset(s) for k in range(4) for s in combinations("abcde", k)]
    gives = lambda s, a: size(s | {a}) == size(s)
    assert set(found.keys) == {s for s in sets if s and size(s) == 1000 and not any(size(s - {c}) == 1000 for c in s)}
    assert set(found.dependencies) == {(s, a) for s in sets if len(s) < 3 and size(s) < 1000 for a in "abcde" if a not in s and gives(s, a) and not any(gives(s - {c}, a) for c in s)}
    assert 0 < len(found.confirmed) < sum(map(len, found.counted))
    one = dependencies.Found(df.limit(1), ["a", "b"])
    assert not one.keys and not one.dependencies


def test_conditions_equal_exhaustive_search(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(9)]), rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None])) for _ in range(40)] + [(1, "z", 4), (2, "z", 4)]
    cells = {}
    for k, v, w in rows:
        for cell in ((), (("v", v),), (("w", w),), (("v", v), ("w", w))):
            cells.setdefault(cell, []).append(k)
    unique = lambda ks: len([k for k in ks if k is not None]) == len({k for k in ks if k is not None})
    holds = {c for c, ks in cells.items() if unique(ks)}
    largest = {c: len(cells[c]) for c in holds if not any(tuple(x for x in c if x != y) in holds for y in c)}
    text = lambda c: " and ".join(f"{n} is null" if x is None else f"{n}={x}" for n, x in c)
    df = spark.createDataFrame(rows, "k int, v string, w int")
    assert {r.condition: r.n_rows for r in conditions.holding(df, ["k"], ["v", "w"]).collect()} == {text(c): n for c, n in largest.items()}
    assert {r.condition for r in conditions.holding(df, ["k"], ["v", "w"], least=3).collect()} == {text(c) for c, n in largest.items() if n >= 3}
    unique_rows = df.where("k is not null").dropDuplicates(["k"])
    assert [tuple(r) for r in conditions.holding(unique_rows, ["k"], ["v", "w"]).collect()] == [("", 9)]
    assert conditions.holding(df.limit(0), ["k"], ["v", "w"]).count() == 0


def test_state_is_read_by_bucket_and_old_rows_not_at_all(spark, tmp_path):
    old = spark.createDataFrame([(i % 500, i % 7 if i % 7 else None) for i in range(600)], "k int, v int")
    old.write.parquet(f"{tmp_path}/old")
    state = KeyState(spark, f"{tmp_path}/state", ["k"], ["v"], buckets=32)
    state.absorb(spark.read.parquet(f"{tmp_path}/old"), "1")
    shutil.rmtree(f"{tmp_path}/old")  # from here on only the state knows
    new = spark.createDataFrame([(3, 1), (3, 2), (600, 1), (601, None), (None, 5), (None, 5), (450, 1)], "k int, v int")
    broken = state.broken_by(new)
    assert {(r.k, r.n) for r in broken.collect()} == {(3, 4), (450, 2)}
    plan = broken._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    touched = {r.bucket for r in state._counted(new).select("bucket").collect()}
    assert len(touched) <= 4 and len({f.split("bucket=")[1].split("/")[0] for f in state.stored().inputFiles()}) > 25
    state.absorb(new, "2")
    state.absorb(new, "2")  # a repeated load replaces itself
    whole = old.unionByName(new)
    expected = {(r.k, r.n) for r in whole.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").collect()}
    assert {(r.k, r.n) for r in state.broken().collect()} == expected and len(expected) == 102 - 1
    empty = KeyState(spark, f"{tmp_path}/empty", ["k"])
    empty.absorb(new.limit(0), "1")
    assert empty.broken().count() == 0 and {(r.k, r.n) for r in empty.broken_by(new).collect()} == {(3, 2)}
    row = state.totals().first()
    assert (row.column_name, row.n_rows, row.nulls) == ("v", 607, whole.where("v is null").count()) and 5 <= row.about <= 7


def test_rows_read_shrink_with_changes(spark, tmp_path):
    rows = [(i, f"v{i}", None if i % 5 == 0 else i) for i in range(3000)] + [(-1, "same", 1)] * 4
    make = lambda x, name: fingerprints.store(spark.createDataFrame(x, "k int, v string, n int").repartition(3), f"{tmp_path}/{name}", ["k"], leaves=64, fan=8)
    first = make(rows, "a")
    assert fingerprints.different_leaves(first, make(rows[::-1], "b"), fan=8) == []
    assert all(r.n == 0 for r in fingerprints.differences(first, make(rows[::-1], "c"), fan=8).collect())
    changed = [(k, "other", n) if k == 7 else (k, v, 1) if k in (5, 10) else (k, v, n) for k, v, n in rows if k != 11][:-1] + [(9999, "new", None)]
    second = make(changed, "d")
    leaves = fingerprints.different_leaves(first, second, fan=8)
    assert 2 <= len(leaves) <= 6 and first.rows(leaves).count() < 500
    assert {(r.kind, r.column_name): r.n for r in fingerprints.differences(first, second, fan=8).collect()} == {("only_first", None): 2, ("only_second", None): 1, ("changed", "v"): 1, ("changed", "n"): 2}
    nothing = make([], "e")
    got = {(r.kind, r.column_name): r.n for r in fingerprints.differences(first, nothing, fan=8).collect()}
    assert got[("only_first", None)] == 3004 and got[("only_second", None)] == 0 and got[("changed", "v")] == 0
