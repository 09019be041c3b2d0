import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rowproof.llm import line_runs

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Rows (id, text) -> per row (id, kept, lines, dropped); a null id is the largest."""
    fold = str.maketrans(line_runs.UPPER, line_runs.LOWER)
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(fold)
            if len(key) >= 10:
                first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(x.strip(SPACE).translate(fold), rank(i)) >= rank(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    common = "This very common line stands in each"
    out = [(i, f"own line number {i}\n{common}\n  {common.upper()}\t\nshort\nline of tens {i // 10}\nÉtude No {i % 3} in É") for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n\n"), (103, " " + common), (104, common + "\r\n" + common), (105, "étude no 1 in é\nÉtude no 1 in É")]
    out += [(7, f"own line number 7\n{common}"), (7, "own line number 7\nanother line of seven"), (8, out[8][1]), (8, out[8][1])]
    out += [(None, f"{common}\nonly the nameless have it"), (None, "only the nameless have it"), (200, "\n".join(f"line {i % 40} of the long text" for i in range(3000))), (201, "\n".join(f"line {i} of the long text" for i in range(60)))]
    return out


@pytest.mark.parametrize(("batches", "fan"), [(1, 3), (5, 2), (7, 3)])
def test_equals_brute_force(spark, batches, fan):
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, pos int, of string").repartition(3)
    got = sorted((tuple(r) for r in line_runs.dedup(df, batches=batches, fan=fan).collect()), key=str)
    assert got == brute(data)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rowproof_run_")]


def test_empty_table(spark):
    assert line_runs.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_and_plan(spark):
    """Four batches make runs in levels, and a look-up shuffles the batch alone."""
    x = line_runs.lines_of(spark.createDataFrame([(i, f"a line of number {i % 30}") for i in range(40)], "doc_id long, text string"))
    index = line_runs.LineRuns(spark, buckets=4, fan=2)
    found = [index.add(x.where(f"doc_id >= {a} and doc_id < {a + 10}")).count() for a in range(0, 40, 10)]
    assert found == [0, 0, 0, 10]
    assert [len(level) for level in index.levels] == [2, 1]
    index.compact()
    assert [len(level) for level in index.levels] == [0, 0, 1]
    index.add(x.where("doc_id = 0 or doc_id = 1"))
    held = spark.sql(" union all ".join(f"select h, g from {run} where not known" for run in index.runs()))
    assert held.count() == 30 == held.distinct().count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.look_up(x.groupBy("h", "g").agg(F.count("*").alias("n")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2, plan  # two runs
    index.close()


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    got = line_runs.op13_line_runs(spark, d)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"select {', '.join(got.columns)} from ({line_runs.OP13_SQL})").fetchall())
    assert line_runs.op13_line_runs(spark, d).where("n_dropped > 0").count() > 0
    one = con.execute("select doc_id, text from documents where text is not null order by doc_id limit 1").fetchone()
    assert got.where(F.col("doc_id") == one[0]).first().kept_sha256 == hashlib.sha256(one[1].encode()).hexdigest()
