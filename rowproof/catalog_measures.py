"""Queries over inequalities, nested values, units and what aggregates depend on, with the SQL each is compared with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rowproof.functions import units
from rowproof.operators import inequality, json_paths, permutation
from rowproof.registry import query
from rowproof.sources.shared import kept


@query("""with o as (select o_orderdate, count(*) as n from orders group by 1), l as (select l_shipdate, count(*) as m from lineitem group by 1)
select year(o_orderdate)::int as o_year, sum(n * m)::bigint as pairs from o join l on l_shipdate < o_orderdate group by 1""")
def inequality_join_pairs(t):
    x = inequality.below(t.orders, "o_orderdate", t.lineitem, "l_shipdate")
    return x.where("n_below > 0").groupBy(F.year("value").alias("o_year")).agg(F.sum(F.col("n_left") * F.col("n_below")).alias("pairs"))


_OPEN = "select o_orderstatus, o_orderdate as s, case when o_custkey % 40 <> 0 then o_orderdate + to_days((o_custkey % 30 - 1)::int) end as e from orders"


@query(f"""with v as ({_OPEN}), d as (select s, e, count(*) as m from v where s <= e group by all), a as (select o_orderstatus, s, e, count(*) as n from v group by all)
select o_orderstatus, sum(n)::bigint as versions, sum(n * coalesce(k, 0))::bigint as overlaps from a left join (select x.s, x.e, sum(d.m) as k from (select distinct s, e from a where s <= e) x join d on d.s <= x.e and d.e >= x.s group by all) using (s, e) group by 1""")
def version_overlaps(t):
    """Versions of orders that are valid at the same time, by status; without an end, or ending before they start, they
    overlap with none."""
    v = t.orders.select("o_orderstatus", F.col("o_orderdate").alias("s"), F.expr("case when o_custkey % 40 <> 0 then o_orderdate + make_interval(0, 0, 0, cast(o_custkey % 30 - 1 as int)) end").alias("e"))
    a = kept(v.groupBy("o_orderstatus", "s", "e").agg(F.count("*").alias("n")), "versions")
    n = inequality.overlaps(a, a, "s", "e", rows="n").select(F.col("s").alias("s2"), F.col("e").alias("e2"), "n_overlaps")
    x = a.join(n, a["s"].eqNullSafe(n["s2"]) & a["e"].eqNullSafe(n["e2"]))
    return x.groupBy("o_orderstatus").agg(F.sum("n").alias("versions"), F.sum(F.col("n") * F.col("n_overlaps")).alias("overlaps"))


_DOC = """case when event_id % 50 = 7 then 'no {json' when event_id % 50 = 8 then null else concat('{"type": "', event_type, '", "props": ', props, case when value > 50 then ', "tags": ["x", 1, {"deep": [null, 2.5]}]' else '' end, case when event_id % 2 = 0 then ', "a b": true' else ', "a b": "no"' end, '}') end"""


@query(f"""with e as (select event_id, value, {_DOC} as doc from events), n as (select count(*) filter (event_id % 50 not in (7, 8)) as n, count(*) filter (event_id % 50 = 7) as bad, count(*) filter (value > 50 and event_id % 50 not in (7, 8)) as tags, count(*) filter (event_id % 50 not in (7, 8) and event_id % 2 = 0) as even from e)
select * from (select '$' as path, case when bad > 0 then 'invalid,object' else 'object' end as types, n + bad as n_values, n + bad as n_rows, false as optional, bad > 0 as mixed from n union all select '$.type', 'string', n, n, false, false from n
union all select '$.props', 'object', n, n, false, false from n union all select '$.props.k', 'integer', n, n, false, false from n union all select '$[["a b"]]', 'boolean,string', n, n, false, true from n
union all select '$.tags', 'array', tags, tags, tags < n, false from n union all select '$.tags[*]', 'integer,object,string', 3 * tags, tags, false, true from n union all select '$.tags[*].deep', 'array', tags, tags, false, false from n
union all select '$.tags[*].deep[*]', 'null,number', 2 * tags, tags, false, false from n) where n_values > 0""")
def json_paths_of_events(t):
    """Paths, types and presence in documents made of each event, some of them broken."""
    x = json_paths.profile(t.events.select("event_id", F.expr(_DOC).alias("doc")), "event_id", "doc")
    return x.withColumn("types", F.array_join("types", ","))


_UNIT = "case when l_suppkey % 10 = 0 then 'eur' when l_suppkey % 25 = 1 then null else 'usd' end"


@query(f"""with l as (select l_returnflag, case when l_linestatus = 'F' then 'usd' else {_UNIT} end as u, l_extendedprice::decimal(18,2) as p, l_quantity::decimal(18,2) as q from lineitem)
select l_returnflag, what, case when n = 1 and unknown = 0 then total end as total, case when n = 1 and unknown = 0 then u end as unit, n as units, unknown from (
select l_returnflag, 'price' as what, sum(p)::double as total, min(u) as u, count(distinct u) as n, count(*) filter (u is null) as unknown from l group by 1
union all select l_returnflag, 'usd only', sum(p)::double, min(u), count(distinct u), count(*) filter (u is null) from l where u = 'usd' group by 1
union all select l_returnflag, 'price a piece', sum(p)::double, 'piece^-1*usd', count(distinct u), count(*) filter (u is null) from l where u = 'usd' group by 1
union all select l_returnflag, 'pieces', sum(q)::double, 'piece', 1, 0 from l group by 1)""")
def unit_exponents(t):
    """Sums of prices, prices a piece and pieces with their units, two currencies and unknown ones among them."""
    currency = F.when(F.col("l_linestatus") == "F", "usd").when(F.col("l_suppkey") % 10 == 0, "eur").when(F.col("l_suppkey") % 25 == 1, None).otherwise("usd")
    x = units.gathered(t.lineitem.withColumn("currency", currency), ["l_returnflag"], ["currency"], {"price": "l_extendedprice", "pieces": "l_quantity"}, 2)
    a_piece = units.over(F.when(F.col("currency").isNotNull(), F.create_map(F.col("currency"), F.lit(1))), units.unit(piece=1))
    price = units.times(a_piece, units.unit(piece=1))
    make = lambda df, what, measure, of: units.sums(df, ["l_returnflag"], measure, of, 2, rows="rows").withColumn("what", F.lit(what))
    usd = x.where(units.agree(price, units.unit(usd=1)))
    parts = [make(x, "price", "price", price), make(usd, "usd only", "price", price), make(usd, "price a piece", "price", a_piece), make(x, "pieces", "pieces", units.unit(piece=1))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_BEHAVIOUR = [("first", "o", "-", "o"), ("last", "o", "-", "o"), ("any_value", "o", "-", "o"), ("collect_list", "o", "d", "o"), ("listagg", "o", "d", "o"), ("max", "-", "-", "-"), ("sum", "-", "d", "-"), ("count_distinct", "-", "-", "-"), ("bit_xor", "-", "d", "-"), ("py_second", "o", "d", "o"), ("py_range", "-", "-", "-")]


@query(" union all ".join(f"select '{n}' as aggregate, n > 1 and {'true' if o == 'o' else 'false'} as order_matters, n > 1 and {'true' if d == 'd' else 'false'} as duplicates_matter, n > 1 and {'true' if p == 'o' else 'false'} as parts_matter from (select count(distinct l_partkey) as n from lineitem)" for n, o, d, p in _BEHAVIOUR))
def aggregates_by_permutation(t):
    """What aggregates depend on, measured over blocks of lines: order, repeated rows, order of the parts."""
    x = t.lineitem.select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    own = {"first": F.first("k"), "last": F.last("k"), "any_value": F.any_value("k"), "collect_list": F.collect_list("k"), "listagg": F.listagg(F.col("k").cast("string"), F.lit(",")), "max": F.max("k"), "sum": F.sum("k"), "bit_xor": F.bit_xor("k")}
    second = F.pandas_udf(_second, "long")
    spread = F.pandas_udf(_range, "long")
    found = permutation.dependence(x, "at", own, {"py_second": second("k"), "py_range": spread("k")}, {"count_distinct": F.count_distinct("k")})
    return found.select("aggregate", *((F.col(f"by_{c}") > 0).alias(f"{c}_matter{s}") for c, s in (("order", "s"), ("duplicates", ""), ("parts", ""))))


def _second(k: pd.Series) -> int:
    return int(k.iloc[min(1, len(k) - 1)])


def _range(k: pd.Series) -> int:
    return int(k.max() - k.min())
