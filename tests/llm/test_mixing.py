import duckdb
import pytest

from rowproof.llm import mixing


def by_definition(sizes):
    """targets by dealing the excess again and again; sizes: {source: size}."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        if not free:
            return {s: 2.0 * sizes[s] for s in names}
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= set(over)


def rows():
    out = [(i, "w " * (i % 50), f"s{i % 7}") for i in range(400)]
    return out + [(1000, None, "s1"), (1001, "", "only empty"), (1002, "a b c", None), (1003, "x " * 5000, "ü"), (1003, "x " * 5000, "ü"), (None, "p q", "s2"), (1004, "one", "S1")]


@pytest.mark.parametrize("bucket", [256, 7])
def test_targets_and_taken(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows()], "doc_id long, text string, source string, key string, bucket int").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows())
    sizes = {}
    for _, t, s in rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = by_definition(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    q = con.execute(mixing.OP3_SQL)
    names = [c[0] for c in q.description]
    expected = sorted((dict(zip(names, r, strict=True)) for r in q.fetchall()), key=lambda r: r["doc_id"])
    got = sorted((r.asDict() for r in mixing.op3_mix_sources(spark, d).collect()), key=lambda r: r["doc_id"])
    assert [{k: r[k] for k in names} for r in got] == expected
