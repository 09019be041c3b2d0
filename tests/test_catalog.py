"""Every query equals its SQL on the smallest tables, values and column names."""

import datetime
import decimal
import math

import duckdb
import pytest

from rowproof import catalog
from rowproof.operators import aggregates

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{round(float(v), 6):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = df.collect()
    q = con.execute(catalog.SQL[name])
    expected_names = [c[0] for c in q.description]
    assert sorted(df.columns) == sorted(expected_names)
    assert rows(df.columns, got) == rows(expected_names, q.fetchall())


def test_every_aggregate_is_measured_under_duplication(spark):
    assert set(aggregates.REGISTRY) <= {r.aggregate for r in catalog.QUERIES["aggregate_duplication_effect"](spark, DIR).collect()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
