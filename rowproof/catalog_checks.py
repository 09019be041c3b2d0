"""Queries over what is declared and what is there: surrogates, documented columns, shown keys, pages, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowproof.functions import surrogate_key
from rowproof.operators import facts, ordering
from rowproof.plans import findings, project, schemas, surrogates
from rowproof.registry import query

_FACT = "model string, property string, columns array<string>, accepted array<string>, parent string, parent_column string, condition string, provenance string"


def _keyed(t):
    """Orders and lines with surrogate keys, one of them over columns that are no key."""
    orders = t.orders.withColumn("order_sk", surrogate_key("o_orderkey")).withColumn("visit_sk", surrogate_key("o_custkey", "o_orderstatus"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").withColumn("line_sk", F.upper(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256)))
    return {"orders": orders, "lines": lines}


_UNIQUE = [("orders", "order_sk", None), ("orders", "visit_sk", None), ("orders", "visit_sk", "o_totalprice > 300000"), ("orders", "o_orderkey", None), ("lines", "line_sk", None)]
_VISITS = "(select count(*) from (select 1 from orders where {} group by o_custkey, o_orderstatus having count(*) > 1))"
_ORDERS = "(select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1))"
_LINES = "(select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))"


def _unique(t):
    return t.spark.createDataFrame([(m, "unique", [c], None, None, None, w, "test") for m, c, w in _UNIQUE], _FACT)


@query(f"""select * from (values ('orders', 'order_sk', 'test', 'checked', {_ORDERS}), ('orders', 'o_orderkey', 'surrogate', 'checked', {_ORDERS}), ('orders', 'o_orderkey', 'test', 'checked', {_ORDERS}),
('orders', 'visit_sk', 'test', 'checked', {_VISITS.format("true")}), ('orders', 'o_custkey,o_orderstatus', 'surrogate', 'checked', {_VISITS.format("true")}),
('orders', 'visit_sk', 'test', 'checked', {_VISITS.format("o_totalprice > 300000")}), ('orders', 'o_custkey,o_orderstatus', 'surrogate', 'checked', {_VISITS.format("o_totalprice > 300000")}),
('lines', 'line_sk', 'test', 'checked', {_LINES}), ('lines', 'l_orderkey,l_linenumber', 'surrogate', 'checked', {_LINES})) as v(model, column_name, provenance, status, broken)""")
def surrogate_inputs_discovered(t):
    """Unique tests on surrogate keys, and the keys of the columns that they are found to be hashes of."""
    tables = _keyed(t)
    return project.check(surrogates.add_inputs(_unique(t), tables.get), tables.get).select("model", "column_name", "provenance", "status", "broken")


@query("""select 'o_custkey,o_orderstatus' as inputs, 'md5' as hash, '-' as separator, count(*) as n_rows, count(*) filter (o_orderkey % 1000 = 0) as mismatches from orders""")
def surrogate_almost_recognised(t):
    """A surrogate key of other columns on a few rows: the rows that are no such hash are counted over all."""
    x = t.orders.withColumn("visit_sk", F.when(F.col("o_orderkey") % 1000 == 0, F.md5(F.lit(""))).otherwise(surrogate_key("o_custkey", "o_orderstatus")))
    first = x.where("o_orderkey % 1000 <> 0").unionByName(x.where("o_orderkey % 1000 = 0"))
    found = surrogates.recognised(first, "visit_sk", ["o_orderkey", "o_custkey", "o_orderstatus"])
    return found.select(F.array_join("inputs", ",").alias("inputs"), "hash", "separator", "n_rows", "mismatches")


_DOCUMENTED = [
    ("orders", "o_orderkey", "bigint"), ("orders", "O_CUSTKEY", "int"), ("orders", "o_orderstatus", "varchar(1)"), ("orders", "o_totalprice", "numeric(12,1)"), ("orders", "o_orderdate", "date"), ("orders", "o_clerk", "text"),
    ("lineitem", "l_quantity", "int64"), ("lineitem", "l_discount", "smallint"), ("lineitem", "l_returnflag", "geography"), ("lineitem", "l_tax", None), ("payments", "id", "int"),
]


@query("""select * from (values ('orders', 'o_custkey', 'type_differs', 'int', 'bigint', (select count(*) from orders where o_custkey not between -2147483648 and 2147483647)),
('orders', 'o_totalprice', 'type_differs', 'numeric(12,1)', 'double', (select count(*) from orders where abs(round(o_totalprice, 1) - o_totalprice) > 1e-6)), ('orders', 'o_orderdate', 'type_differs', 'date', 'timestamp_ntz', (select count(*) from orders where o_orderdate <> date_trunc('day', o_orderdate))),
('orders', 'o_clerk', 'missing_column', 'text', null, null), ('orders', 'o_orderpriority', 'undeclared_column', null, 'string', null),
('lineitem', 'l_quantity', 'type_differs', 'int64', 'double', (select count(*) from lineitem where l_quantity <> trunc(l_quantity))), ('lineitem', 'l_discount', 'type_differs', 'smallint', 'double', (select count(*) from lineitem where l_discount <> trunc(l_discount))),
('lineitem', 'l_returnflag', 'unknown_type', 'geography', 'string', null), ('payments', null, 'missing_relation', null, null, null)) as v(model, column_name, kind, declared, actual, unfit)
union all select 'lineitem', c, 'undeclared_column', null, k, null from (values ('l_orderkey', 'bigint'), ('l_partkey', 'bigint'), ('l_suppkey', 'bigint'), ('l_linenumber', 'int'), ('l_extendedprice', 'double'), ('l_linestatus', 'string'), ('l_shipdate', 'timestamp_ntz')) as u(c, k)""")
def documented_columns_compared(t):
    """Documented columns against the tables, with the rows whose value the documented type cannot hold."""
    documented = t.spark.createDataFrame(_DOCUMENTED, "model string, name string, data_type string")
    return schemas.compare(documented, lambda name: getattr(t, name) if name in ("orders", "lineitem") else None)


@query("""select o_custkey, count(*) as n_groups from (select distinct o_custkey, o_orderstatus, date_trunc('month', o_orderdate) as month from orders) group by 1 having count(*) > 1""")
def hidden_group_keys(t):
    """A result grouped by customer, status and month that shows the customer: rows that look alike."""
    keys = {"o_custkey": F.col("o_custkey"), "status": F.col("o_orderstatus"), "month": F.trunc("o_orderdate", "month")}
    return facts.hidden_group_keys(t.orders, keys, ["o_custkey"])


_PAGED = "select case when l_quantity < 3 then null else l_quantity end as v from lineitem"


@query(f"""with a as (select v, count(*) as tied from ({_PAGED}) group by 1), b as (select v, tied, sum(tied) over (order by v nulls first rows between unbounded preceding and current row) - tied as before from a)
select v as value, tied, (before // 1000)::bigint as first_page, ((before + tied - 1) // 1000)::bigint as last_page from b where (before + tied - 1) // 1000 > before // 1000""")
def page_border_ties(t):
    """Quantities whose lines lie on more than one page of 1,000 lines, NULLs first."""
    return ordering.page_ties(t.lineitem.select(F.expr("case when l_quantity >= 3 then l_quantity end").alias("v")), "v", 1000)


def _checked(t):
    rows = [("orders", "unique", ["o_orderkey"], None), ("orders", "not_null", ["o_clerk"], None), ("orders", "unique", ["o_custkey"], "o_total > 1"), ("lines", "unique", ["line_sk"], None), ("lines", "shaped_like", ["line_sk"], None), ("payments", "unique", ["id"], None)]
    declared = t.spark.createDataFrame([(m, p, c, None, None, None, w, "test") for m, p, c, w in rows], _FACT)
    return project.check(declared, _keyed(t).get)


@query("""select 'unique' as property, 4 as declared, 2 as grounded, count(*) > 0 as any_rows from orders union all select 'not_null', 1, 0, count(*) > 0 from orders union all select 'shaped_like', 1, 0, count(*) > 0 from orders""")
def fact_grounding(t):
    """How many facts of each property could be checked."""
    return findings.grounding(_checked(t)).join(F.broadcast(t.orders.agg((F.count("*") > 0).alias("any_rows"))))  # one row


@query("""select * from (values ('payments', 1, 0, 0.0, 0), ('orders', 3, 1, 1 / 3, (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1)))) as v(model, declared, checked, share, broken)""")
def least_covered_models(t):
    """The two models with the lowest share of checked facts, and what their checked facts found."""
    checked = _checked(t)
    broken = checked.groupBy("model").agg(F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))
    return findings.least_covered(checked, 2).join(broken, "model")
