"""Queries over joins, worlds, stored state and builds as wholes, with the SQL each is compared with."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from rowproof.plans import conditions, dependencies, findings, fingerprints
from rowproof.plans.fact_state import KeyState
from rowproof.plans.join_chain import JoinChain, Step
from rowproof.plans.worlds import enumerate_worlds, facts_by_world
from rowproof.registry import query
from rowproof.sources.shared import shared_folder
from rowproof.streaming import drain, read_files
from rowproof.streaming.facts import repeated_keys

# ---- join chains -----------------------------------------------------------------------------------------------


def _chain(t) -> JoinChain:
    lines = t.lineitem.select("l_orderkey", F.expr("case when l_quantity > 10 then l_partkey end").alias("l_partkey"), "l_suppkey")
    return JoinChain("customer", t.customer, [
        Step("orders", t.orders.where("o_totalprice > 150000"), "customer", "c_custkey", "o_custkey"),
        Step("lineitem", lines.where("l_suppkey % 3 <> 0"), "orders", "o_orderkey", "l_orderkey"),
        Step("part", t.part.where("p_size < 30"), "lineitem", "l_partkey", "p_partkey"),
        Step("supplier", t.supplier.where("s_acctbal > 2000"), "lineitem", "l_suppkey", "s_suppkey", "inner"),
        Step("nation", t.nation.where("n_regionkey <> 2"), "customer", "c_nationkey", "n_nationkey"),
    ])


_CHAIN = """with o as (select * from orders where o_totalprice > 150000), l as (select l_orderkey, case when l_quantity > 10 then l_partkey end as l_partkey, l_suppkey from lineitem where l_suppkey % 3 <> 0),
p as (select * from part where p_size < 30), s as (select * from supplier where s_acctbal > 2000), n as (select * from nation where n_regionkey <> 2),
j1 as materialized (select c_custkey, c_nationkey, o_orderkey, o_custkey from customer left join o on o_custkey = c_custkey),
j2 as materialized (select j1.*, l_orderkey, l_partkey, l_suppkey from j1 left join l on l_orderkey = o_orderkey),
j3 as materialized (select j2.*, p_partkey from j2 left join p on p_partkey = l_partkey),
j4 as materialized (select j3.*, s_suppkey from j3 join s on s_suppkey = l_suppkey),
j5 as materialized (select j4.*, n_nationkey from j4 left join n on n_nationkey = c_nationkey)"""


@query(f"""{_CHAIN}
select 'orders' as step, 'left' as how, (select count(*) from customer) as rows_in, (select count(*) from customer where c_custkey in (select o_custkey from o)) as matched, count(*) filter (o_custkey is null) as unmatched, 0 as padded_before, count(*) as rows_out from j1
union all select 'lineitem', 'left', (select count(*) from j1), (select count(*) from j1 where o_orderkey in (select l_orderkey from l)), count(*) filter (l_orderkey is null and o_orderkey is not null), count(*) filter (o_orderkey is null), count(*) from j2
union all select 'part', 'left', (select count(*) from j2), count(p_partkey), count(*) filter (p_partkey is null and l_orderkey is not null), count(*) filter (l_orderkey is null), count(*) from j3
union all select 'supplier', 'inner', (select count(*) from j3), (select count(*) from j4), (select count(*) from j3 where l_orderkey is not null and l_suppkey not in (select s_suppkey from s)), (select count(*) from j3 where l_orderkey is null), (select count(*) from j4)
union all select 'nation', 'left', (select count(*) from j4), count(n_nationkey), count(*) filter (n_nationkey is null), 0, count(*) from j5""")
def join_chain_accounts(t):
    return _chain(t).account()


@query(f"""{_CHAIN}
select * from (select 'orders' as step, 'orders' as cause, count(*) as n from j1 where o_orderkey is null
union all select 'lineitem', 'lineitem', count(*) from j2 where o_orderkey is not null and l_orderkey is null
union all select 'lineitem', 'orders', count(*) from j2 where o_orderkey is null
union all select 'part', 'part', count(*) from j3 where l_orderkey is not null and p_partkey is null
union all select 'part', 'lineitem', count(*) from j3 where o_orderkey is not null and l_orderkey is null
union all select 'part', 'orders', count(*) from j3 where o_orderkey is null
union all select 'supplier', 'supplier', count(*) from j3 where l_orderkey is not null and l_suppkey not in (select s_suppkey from s)
union all select 'supplier', 'lineitem', count(*) from j3 where o_orderkey is not null and l_orderkey is null
union all select 'supplier', 'orders', count(*) from j3 where o_orderkey is null
union all select 'nation', 'nation', count(*) from j5 where n_nationkey is null) where n > 0""")
def join_chain_causes(t):
    return _chain(t).causes()


# ---- worlds ----------------------------------------------------------------------------------------------------

_AXES = {"load": {"full": "true", "recent": "o_orderdate >= timestamp '1998-01-01'"}, "status": {"all": "true", "filled": "o_orderstatus = 'F'"}, "size": {"all": "true", "none": "o_totalprice < 0"}}
_WORLDS = [(f"load={a},status={b},size={c}", f"({x}) and ({y}) and ({z})") for a, x in _AXES["load"].items() for b, y in _AXES["status"].items() for c, z in _AXES["size"].items()]
_WORLD_FACTS = {
    "one order a customer": "(select count(*) from (select 1 from w group by o_custkey having count(*) > 1))", "order key": "(select count(*) from (select 1 from w group by o_orderkey having count(*) > 1))",
    "status by priority": "(select count(*) from (select 1 from w group by o_orderpriority having count(distinct o_orderstatus) > 1))", "price below 400000": "(select count(*) from w where not o_totalprice < 400000)", "known priority": "(select count(*) from w where not o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))",
}
_BY_WORLD = " union all ".join(f"(with w as (select * from orders where {c}) select '{f}' as fact, '{name}' as world, {sql}::bigint as broken)" for name, c in _WORLDS for f, sql in _WORLD_FACTS.items())


def _by_world(t):
    worlds = enumerate_worlds({axis: {k: F.expr(c) for k, c in x.items()} for axis, x in _AXES.items()})
    claims = {"price below 400000": F.col("o_totalprice") < 400000, "known priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")}
    return list(worlds), facts_by_world(t.orders, worlds, {"one order a customer": ["o_custkey"], "order key": ["o_orderkey"]}, claims, {"status by priority": (["o_orderpriority"], "o_orderstatus")})


@query(_BY_WORLD)
def facts_in_worlds(t):
    return _by_world(t)[1]


@query(f"select fact, string_agg(world, ';' order by world) as worlds from ({_BY_WORLD}) where broken > 0 group by fact having count(*) < {len(_WORLDS)}")
def facts_broken_in_some_worlds(t):
    worlds, x = _by_world(t)
    some = findings.only_in_some_worlds(x.where("broken > 0"), worlds, identity=("fact",))
    return some.select("fact", F.array_join("worlds", ";").alias("worlds"))


# ---- facts found and kept --------------------------------------------------------------------------------------


def _sets(columns: list[str], most: int) -> list[tuple[str, ...]]:
    return [s for k in range(1, most + 1) for s in combinations(sorted(columns), k)]


def _sizes_sql(table: str, columns: list[str], most: int) -> str:
    """CTEs: sz(s, n), the different values of every set of columns; inside(s, part), the proper subsets of each set."""
    name = ",".join
    sizes = " union all ".join(f"select '{name(s)}' as s, count(*) as n from (select distinct {name(s)} from {table})" for s in _sets(columns, most))
    inside = ", ".join(f"('{name(s)}', '{name(p)}')" for s in _sets(columns, most) for k in range(len(s)) for p in combinations(s, k))
    return f"sz as materialized (select '' as s, 1 as n union all {sizes}), inside as (select * from (values {inside}) as v(s, part)), total as (select count(*) as n from {table})"


def _dependencies_sql(table: str, columns: list[str], most: int) -> str:
    name = ",".join
    tests = ", ".join(f"('{name(s)}', '{a}', '{name(sorted({*s, a}))}')" for s in [(), *_sets(columns, most - 1)] for a in sorted(columns) if a not in s)
    return f"""with {_sizes_sql(table, columns, most)}, tests as (select v.z, v.a, l.n as n, l.n = r.n as holds from (values {tests}) as v(z, a, za) join sz l on l.s = v.z join sz r on r.s = v.za)
select z as determinant, a as dependent from tests where holds and n < (select n from total) and not exists (select 1 from inside join tests t on t.z = inside.part and t.a = tests.a and t.holds where inside.s = tests.z)
union all select s, null from sz where s <> '' and n = (select n from total) and not exists (select 1 from inside join sz p on p.s = inside.part where inside.s = sz.s and p.n = sz.n)"""


_ORDERS = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
_LINES = ["l_discount", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_tax"]


@query(_dependencies_sql("orders", _ORDERS, 3))
def dependencies_of_orders(t):
    return dependencies.Found(t.orders, _ORDERS, 3).frame()


@query(_dependencies_sql("(select *, l_orderkey % 1000 // 10 as l_batch, l_orderkey % 1000 as l_part_of from lineitem)", [*_LINES, "l_batch", "l_part_of"], 3))
def dependencies_of_lines(t):
    derived = t.lineitem.withColumn("l_part_of", F.col("l_orderkey") % 1000).withColumn("l_batch", F.expr("l_orderkey % 1000 div 10"))
    return dependencies.Found(derived, [*_LINES, "l_batch", "l_part_of"], 3).frame()


_WHERE = ["o_orderpriority", "o_orderstatus", "o_month"]
_KEY_ROWS = "(select o_custkey, o_orderpriority, nullif(o_orderstatus, 'O') as o_orderstatus, strftime(o_orderdate, '%Y-%m') as o_month from orders)"


@query(f"""with r as (select * from {_KEY_ROWS}), c as (select {', '.join(_WHERE)}, grouping({_WHERE[0]}) as g0, grouping({_WHERE[1]}) as g1, grouping({_WHERE[2]}) as g2, count(*) as n_rows from r group by cube ({', '.join(_WHERE)})),
k as (select {', '.join(_WHERE)}, g0, g1, g2, count(*) as repeated from (select {', '.join(_WHERE)}, grouping({_WHERE[0]}) as g0, grouping({_WHERE[1]}) as g1, grouping({_WHERE[2]}) as g2, count(*) as n from r group by grouping sets ({', '.join('(o_custkey' + ''.join(', ' + c for c in s) + ')' for k in range(4) for s in combinations(_WHERE, k))})) where n > 1 group by all),
x as (select c.*, k.repeated is null as holds from c left join k on {' and '.join(f'c.{a} is not distinct from k.{a}' for a in [*_WHERE, 'g0', 'g1', 'g2'])})
select concat_ws(' and ', case when g0 = 0 then coalesce('o_orderpriority=' || o_orderpriority, 'o_orderpriority is null') end, case when g1 = 0 then coalesce('o_orderstatus=' || o_orderstatus, 'o_orderstatus is null') end, case when g2 = 0 then coalesce('o_month=' || o_month, 'o_month is null') end) as condition, n_rows from x
where holds and not exists (select 1 from x p where p.holds and p.g0 + p.g1 + p.g2 = x.g0 + x.g1 + x.g2 + 1 and p.g0 >= x.g0 and p.g1 >= x.g1 and p.g2 >= x.g2
and (p.g0 = 1 or p.o_orderpriority is not distinct from x.o_orderpriority) and (p.g1 = 1 or p.o_orderstatus is not distinct from x.o_orderstatus) and (p.g2 = 1 or p.o_month is not distinct from x.o_month))""")
def conditional_keys_found(t):
    rows = t.orders.select("o_custkey", "o_orderpriority", F.expr("nullif(o_orderstatus, 'O')").alias("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM").alias("o_month"))
    return conditions.holding(rows, ["o_custkey"], _WHERE)


_NEW = "o_orderdate >= timestamp '2000-06-01'"


@query(f"""with o as (select *, nullif(o_custkey, 7) as k from orders) select k as o_custkey, count(*) as n, count(*) filter ({_NEW}) > 0 as by_new from o where k is not null group by 1 having count(*) > 1""")
def key_state_of_two_loads(t):
    """Repeated keys of two loads from their stored states, and which of them the second load broke."""
    o = t.orders.withColumn("o_custkey", F.expr("nullif(o_custkey, 7)"))
    state = KeyState(t.spark, f"{shared_folder(t.spark)}/rowproof/key-state-{uuid.uuid4().hex[:12]}", ["o_custkey"], ["o_orderpriority", "o_custkey"])
    old, new = o.where(f"not {_NEW}"), o.where(_NEW)
    state.absorb(old, "old")
    broken = state.broken_by(new).select("o_custkey", F.lit(True).alias("by_new"))
    state.absorb(new, "new")
    return state.broken().join(broken, "o_custkey", "left").select("o_custkey", "n", F.coalesce("by_new", F.lit(False)).alias("by_new"))


@query("""select 'only_first' as kind, null as column_name, count(*) filter (o_orderkey % 1009 = 5) as n from orders union all select 'only_second', null, count(*) filter (o_orderkey % 2003 = 8 and o_orderkey % 1009 <> 5) from orders
union all select 'changed', 'o_totalprice', count(*) filter (o_orderkey % 997 = 3 and o_orderkey % 1009 <> 5) from orders union all select 'changed', 'o_orderstatus', count(*) filter (o_orderkey % 4001 = 4 and o_orderstatus <> 'P' and o_orderkey % 1009 <> 5) from orders
union all select 'changed', c, 0 from (select unnest(['o_custkey', 'o_orderdate', 'o_orderpriority']) as c)""")
def build_differences(t):
    """A second build without some rows, with new keys and with changes in two columns, compared by fingerprints."""
    folder = f"{shared_folder(t.spark)}/rowproof/builds-{uuid.uuid4().hex[:12]}"
    kept = t.orders.where("o_orderkey % 1009 <> 5")
    changed = kept.withColumn("o_totalprice", F.expr("case when o_orderkey % 997 = 3 then o_totalprice + 1 else o_totalprice end")).withColumn("o_orderstatus", F.expr("case when o_orderkey % 4001 = 4 then 'P' else o_orderstatus end"))
    added = kept.where("o_orderkey % 2003 = 8").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return fingerprints.differences(fingerprints.store(t.orders, f"{folder}/first", ["o_orderkey"]), fingerprints.store(changed.unionByName(added), f"{folder}/second", ["o_orderkey"]))


# ---- facts over streams ----------------------------------------------------------------------------------------


@query("""select user_id, event_type, count(*) as n from events where event_type <> 'view' group by all having count(*) > 1""")
def stream_repeated_keys(t):
    """Repeated keys of the events as a stream with state of its own: the last number sent for each."""
    events = read_files(t.spark, t.sf_dir, "events.parquet").where("event_type <> 'view'")
    return drain(repeated_keys(events, ["user_id", "event_type"]), "update").groupBy("user_id", "event_type").agg(F.max("n").alias("n"))
