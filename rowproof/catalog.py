"""All queries over the given tables and the SQL each is compared with.

The tables are TPC-H-like and mostly clean, so nullable keys, empty arrays and versions are derived from them by
expressions (never by changing data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowproof.functions import field_check, money, surrogate_key, total
from rowproof.operators import aggregates, arrays, facts, history, joins, ordering
from rowproof.operators.contracts import Agg, compare, violations
from rowproof.plans import findings, incremental, lineage, project, replay
from rowproof.registry import QUERIES, SQL, query
from rowproof.streaming import drain, read_files, window_counts

# ---- joins and NULLs -------------------------------------------------------------------------------------------


@query("""select o_orderstatus, count(*) as n_rows, sum(c_acctbal::decimal(18,2))::double as total
from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000 group by o_orderstatus having o_orderstatus is null""")
def null_group_bucket(t):
    big = t.orders.where("o_totalprice > 400000")
    return joins.null_group(t.customer, big, F.col("c_custkey") == F.col("o_custkey"), "o_orderstatus", "c_acctbal", scale=2)


@query("""with a as (select nullif(o_custkey % 7, 0) as a from orders), b as (select nullif(c_custkey % 11, 0) as b from customer)
select coalesce(a, -1) as k, count(*) as false_matches from a join b on coalesce(a, -1) = coalesce(b, -1) where (a = b) is null group by 1""")
def coalesce_key_false_matches(t):
    a = t.orders.select(F.expr("nullif(o_custkey % 7, 0)").alias("a"))
    b = t.customer.select(F.expr("nullif(c_custkey % 11, 0)").alias("b"))
    return joins.sentinel_matches(a, b, "a", "b", -1)


@query("""select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""")
def where_inversion_lost_rows(t):
    return joins.lost_to_where(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey"), F.col("o_totalprice") > 400000).select("c_custkey", "c_mktsegment")


@query("""select coalesce(m, 0) as matches, count(*) as left_rows from orders left join (select l_orderkey, count(*) as m from lineitem group by 1) on l_orderkey = o_orderkey group by 1""")
def join_fanout_multiplicity(t):
    return joins.fanout(t.orders, t.lineitem, "o_orderkey", "l_orderkey")


@query("""with m as (select l_orderkey, count(*) as m from lineitem group by 1)
select * from (select o_custkey, sum(o_totalprice::decimal(18,2))::double as at_origin, sum(o_totalprice::decimal(18,2) * coalesce(m, 0))::double as after_join
from orders left join m on l_orderkey = o_orderkey group by 1) where at_origin <> after_join""")
def fanout_inflated_sum(t):
    return joins.inflated_sum(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "o_custkey", "o_totalprice", scale=2)


@query("""with l as (select nullif(c_nationkey % 9, 0) as k from customer), r as (select nullif(s_nationkey % 5, 0) as k from supplier)
select 'left' as side, count(*) as n_rows, count(*) filter (k is null) as null_keys, count(*) filter (k is not null and k not in (select k from r where k is not null)) as unmatched from l
union all select 'right', count(*), count(*) filter (k is null), count(*) filter (k is not null and k not in (select k from l where k is not null)) from r""")
def nullable_join_key_loss(t):
    l = t.customer.select(F.expr("nullif(c_nationkey % 9, 0)").alias("k1"))
    r = t.supplier.select(F.expr("nullif(s_nationkey % 5, 0)").alias("k2"))
    return joins.key_loss(l, r, "k1", "k2")


@query("""with s as (select case when o_totalprice > 300000 then o_custkey end as k from orders)
select (select count(*) from customer where c_custkey not in (select k from s)) as not_in_rows, (select count(*) from customer where not exists (select 1 from s where k = c_custkey)) as not_exists_rows""")
def not_in_null_trap(t):
    s = t.orders.select(F.expr("case when o_totalprice > 300000 then o_custkey end").alias("k2"))
    return joins.not_in_trap(t.customer, s, "c_custkey", "k2")


@query("""select o_orderkey, o_orderstatus from orders where nullif(o_custkey % 5, 0) is null""")
def anti_join_null_probe(t):
    a = t.orders.withColumn("probe", F.expr("nullif(o_custkey % 5, 0)"))
    return joins.null_probes_kept(a, t.customer.select(F.col("c_custkey").alias("k2")), "probe", "k2").select("o_orderkey", "o_orderstatus")


@query("""with a as (select o_orderkey as k from orders where o_totalprice > 100000), b as (select l_orderkey as k2 from lineitem where l_quantity > 25)
select case when k2 is null then 'left only' when k is null then 'right only' else 'matched' end as kind, count(*)::bigint as n from a full join b on k = k2 group by 1""")
def full_join_padding(t):
    return joins.padded_rows(t.orders.where("o_totalprice > 100000"), t.lineitem.where("l_quantity > 25"), "o_orderkey", "l_orderkey").select("kind", F.col("n").cast("long").alias("n"))


@query("""select c_custkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 350000 where o_orderkey is null""")
def left_is_null_anti_join(t):
    return t.customer.join(t.orders.where("o_totalprice > 350000"), F.col("c_custkey") == F.col("o_custkey"), "left").where("o_orderkey is null").select("c_custkey")


@query("""select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)""")
def semi_join_keeps_probe_key(t):
    return t.customer.join(t.orders.where("o_totalprice > 350000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""select k, count(*) as null_group_rows from (select nullif(c_nationkey, 3) as k from customer) group by 1 having k is null""")
def nullable_group_rows(t):
    return t.customer.select(F.expr("nullif(c_nationkey, 3)").alias("k")).groupBy("k").agg(F.count("*").alias("null_group_rows")).where("k is null")


# ---- order -----------------------------------------------------------------------------------------------------


@query("""select size, count(*) as partitions from (select count(*) as size from lineitem group by l_orderkey having count(*) > 1) group by 1""")
def unordered_window_exposure(t):
    return ordering.arbitrary_labels(t.lineitem, ["l_orderkey"])


@query("""select l_partkey, l_suppkey, l_shipdate, count(*) as tied from lineitem group by all having count(*) > 1""")
def window_order_ties(t):
    return ordering.order_ties(t.lineitem, ["l_partkey", "l_suppkey"], ["l_shipdate"])


@query("""select l_orderkey, count(distinct l_shipdate) as values, count(*) as n_rows from lineitem group by 1 having count(distinct l_shipdate) > 1""")
def unordered_agg_exposure(t):
    return ordering.order_dependent_groups(t.lineitem, ["l_orderkey"], "l_shipdate")


@query("""select o_custkey, count(*)::bigint as reached from (select o_custkey, rank() over (partition by o_custkey order by o_orderdate desc nulls last) as r from orders) where r <= 2 group by 1 having count(*) > 2""")
def topn_agg_ties(t):
    return ordering.top_n_ties(t.orders, ["o_custkey"], "o_orderdate", 2).select("o_custkey", F.col("reached").cast("long").alias("reached"))


@query("""select cutoff, tied, (100 - before)::bigint as taken from (select o_orderpriority as cutoff, count(*) as tied, sum(count(*)) over (order by o_orderpriority) - count(*) as before from orders group by 1)
where before < 100 and before + tied > 100""")
def limit_cutoff_ties(t):
    return ordering.cutoff_ties(t.orders, "o_orderpriority", 100).select("cutoff", "tied", F.col("taken").cast("long").alias("taken"))


@query("""select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1""")
def rownumber_dedup(t):
    return facts.first_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""with d as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1)
select (select count(*) from (select o_custkey from d group by 1 having count(*) > 1)) as dedup_broken, (select count(*) from (select o_custkey from orders group by 1 having count(*) > 1)) as source_broken""")
def rownumber_dedup_is_key(t):
    d = facts.first_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    broken = lambda df, name: facts.key_violations(df, ["o_custkey"]).agg(F.count("*").alias(name))
    return broken(d, "dedup_broken").join(F.broadcast(broken(t.orders, "source_broken")))


@query("""select l_orderkey, l_linenumber, l_partkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as drk, ntile(3) over w as nt,
round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd, coalesce(lag(l_partkey) over w, -1) as prev_part, coalesce(lead(l_partkey) over w, -1) as next_part,
first_value(l_partkey) over w as first_part, last_value(l_partkey) over (w2 rows between unbounded preceding and unbounded following) as last_part, coalesce(nth_value(l_partkey, 2) over (w2 rows between unbounded preceding and unbounded following), -1) as second_part
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as u from lineitem)
window w as (partition by l_orderkey order by l_linenumber, u), w2 as (partition by l_orderkey order by l_linenumber, u)""")
def window_functions(t):
    total_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    x = t.lineitem.withColumn("u", F.row_number().over(total_order))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "u")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = F.col("l_partkey")
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("drk"), F.ntile(3).over(w).cast("long").alias("nt"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.coalesce(F.lag(part).over(w), F.lit(-1)).alias("prev_part"), F.coalesce(F.lead(part).over(w), F.lit(-1)).alias("next_part"),
        F.first(part).over(w).alias("first_part"), F.last(part).over(whole).alias("last_part"), F.coalesce(F.nth_value(part, 2).over(whole), F.lit(-1)).alias("second_part"),
    )


# ---- arrays, versions, incremental loads -----------------------------------------------------------------------

_LONG_WORDS = "list_filter(string_split(text, ' '), lambda w: length(w) > 11)"


def _long_words():
    return F.filter(F.split("text", " "), lambda w: F.length(w) > 11)


@query(f"select doc_id, source from documents where text is null or len({_LONG_WORDS}) = 0")
def flatten_dropped_parents(t):
    return arrays.dropped_parents(t.documents, _long_words()).select("doc_id", "source")


@query(f"select count(*) as parents, sum(n)::bigint as inner_rows, sum(greatest(n, 1))::bigint as outer_rows from (select coalesce(len({_LONG_WORDS}), 0) as n from documents)")
def flatten_inner_outer_rows(t):
    return arrays.flatten_counts(t.documents, _long_words())


_HISTORY = "(select *, ts as valid_from, lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_to from events)"


def _history(t):
    return history.versions(t.events, ["user_id", "event_type"], "ts", "event_id")


@query(f"select user_id, event_type, count(*) as versions, count(*) filter (valid_to is null) as current from {_HISTORY} group by all having count(*) > 1")
def scd2_version_fanout(t):
    return history.version_fanout(_history(t), ["user_id", "event_type"])


@query(f"select event_id, user_id, event_type, value from {_HISTORY} where valid_to is null")
def scd2_current_rows(t):
    return history.current(_history(t)).select("event_id", "user_id", "event_type", "value")


@query(f"select event_id, user_id, event_type from {_HISTORY}, (select min(ts) + (max(ts) - min(ts)) / 2 as m from events) where valid_from <= m and (valid_to is null or valid_to > m)")
def scd2_as_of(t):
    mid = t.events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("m"))
    return history.as_of(_history(t).join(F.broadcast(mid)), F.col("m")).select("event_id", "user_id", "event_type")


@query("""with batch as (select user_id, event_type, max(event_id) as event_id from events where event_id % 3 = 0 group by all)
select (select count(*) from events where event_id % 3 <> 0) + (select count(*) from events where event_id % 3 = 0) as append_rows,
(select count(*) from events e where event_id % 3 <> 0 and not exists (select 1 from batch b where b.user_id = e.user_id and b.event_type = e.event_type)) + (select count(*) from batch) as merge_rows,
(select count(*) from events e where event_id % 3 <> 0 and not exists (select 1 from batch b where b.user_id = e.user_id and b.event_type = e.event_type)) + (select count(*) from events where event_id % 3 = 0) as delete_insert_rows""")
def incremental_merge_vs_append(t):
    target, batch = t.events.where("event_id % 3 <> 0"), t.events.where("event_id % 3 = 0")
    n = lambda s, name: incremental.load(target, batch, s, ["user_id", "event_type"], [F.col("event_id").desc()]).agg(F.count("*").alias(name))
    return n("append", "append_rows").join(F.broadcast(n("merge", "merge_rows"))).join(F.broadcast(n("delete+insert", "delete_insert_rows")))


@query("""select event_type, count(*) as late from events where event_id % 5 = 0 and ts <= (select max(ts) from events where event_id % 5 <> 0 and event_type <> 'purchase') group by 1""")
def watermark_late_rows(t):
    target = t.events.where("event_id % 5 <> 0 and event_type <> 'purchase'")
    return incremental.late_rows(target, t.events.where("event_id % 5 = 0"), "ts").groupBy("event_type").agg(F.count("*").alias("late"))


@query("""select event_type, date_trunc('day', ts)::timestamp as window_start, count(*) as n from events group by all""")
def streaming_daily_counts(t):
    stream = window_counts(read_files(t.spark, t.sf_dir, "events.parquet"), "ts", ["event_type"])
    return drain(stream, "complete").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


# ---- declared facts --------------------------------------------------------------------------------------------


@query("""select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1""")
def key_violations_composite(t):
    return facts.key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""select o_orderkey, count(*) as n from orders group by all having count(*) > 1""")
def key_violations_single(t):
    return facts.key_violations(t.orders, ["o_orderkey"])


@query("""select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' and o_totalprice > 200000 group by all having count(*) > 1""")
def conditional_key_violations(t):
    return facts.key_violations(t.orders, ["o_custkey"], F.expr("o_orderpriority = '1-URGENT' and o_totalprice > 200000"))


@query("""select md5(concat_ws('-', coalesce(o_custkey::varchar, '_null_'), coalesce(o_orderstatus, '_null_'))) as surrogate, count(*) as n, count(distinct (o_custkey, o_orderstatus)) as n_inputs from orders group by 1 having count(*) > 1""")
def surrogate_key_violations(t):
    return facts.surrogate_violations(t.orders, ["o_custkey", "o_orderstatus"]).withColumn("n", F.col("n").cast("long"))


@query("""select o_custkey, (count(distinct o_orderstatus) + max(case when o_orderstatus is null then 1 else 0 end))::bigint as n_values from orders group by 1 having n_values > 1""")
def fd_violations(t):
    return facts.fd_violations(t.orders, ["o_custkey"], "o_orderstatus").select("o_custkey", F.col("n_values").cast("long").alias("n_values"))


@query("""select n_nationkey, count(distinct n_name)::bigint as n_values from nation group by 1 having n_values > 1""")
def fd_holds(t):
    return facts.fd_violations(t.nation, ["n_nationkey"], "n_name").select("n_nationkey", F.col("n_values").cast("long").alias("n_values"))


@query("""select 'k' as column_name, count(*) as nulls from orders where nullif(o_custkey % 13, 0) is null having count(*) > 0""")
def not_null_violations(t):
    return facts.null_violations(t.orders.withColumn("k", F.expr("nullif(o_custkey % 13, 0)")), ["o_orderkey", "k", "o_totalprice"])


@query("""select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)""")
def fk_orphans(t):
    return facts.orphans(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("""select o_orderpriority, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') group by 1""")
def accepted_values_violations(t):
    return facts.rejected_values(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("""select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity > 49 or l_discount < 0.01""")
def range_violations(t):
    return t.lineitem.where(field_check("l_quantity", le=49) | field_check("l_discount", ge=0.01)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("""select p_partkey, p_size from part where p_size % 2 <> 0""")
def multiple_of_violations(t):
    return t.part.where(field_check("p_size", multiple_of=2)).select("p_partkey", "p_size")


@query("""select p_partkey, p_name from part where length(p_name) < 6 or length(p_name) > 9""")
def length_violations(t):
    return t.part.where(field_check("p_name", min_length=6, max_length=9)).select("p_partkey", "p_name")


@query("""select claim, broken from (select 'order key' as claim, (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1)) as broken
union all select 'line key', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))
union all select 'order customer', (select count(*) from orders where o_custkey not in (select c_custkey from customer))
union all select 'nation name by key', (select count(*) from (select 1 from nation group by n_nationkey having count(distinct n_name) > 1)))""")
def fact_summary(t):
    return facts.fact_summary({
        "order key": facts.key_violations(t.orders, ["o_orderkey"]),
        "line key": facts.key_violations(t.lineitem, ["l_orderkey", "l_linenumber"]),
        "order customer": facts.orphans(t.orders, t.customer, "o_custkey", "c_custkey"),
        "nation name by key": facts.fd_violations(t.nation, ["n_nationkey"], "n_name"),
    })


@query("""select event_id, value from events where value > 50 and not (value > 60 and event_type = 'click')""")
def implication_counterexamples(t):
    return facts.counterexamples(t.events, F.expr("value > 50"), F.expr("value > 60 and event_type = 'click'")).select("event_id", "value")


@query("""select event_id from events where value > 60 and not (value > 50)""")
def implication_holds(t):
    return facts.counterexamples(t.events, F.expr("value > 60"), F.expr("value > 50")).select("event_id")


# ---- aggregates and units --------------------------------------------------------------------------------------


@query("""select o_custkey, count(distinct o_orderstatus) as units, sum(o_totalprice::decimal(18,2))::double as mixed_total from orders group by 1 having count(distinct o_orderstatus) > 1""")
def mixed_unit_groups(t):
    return aggregates.mixed_units(t.orders, ["o_custkey"], "o_orderstatus", "o_totalprice", scale=2)


@query("""select o_custkey, o_orderstatus, count(distinct o_orderstatus) as units, sum(o_totalprice::decimal(18,2))::double as mixed_total from orders group by 1, 2 having count(distinct o_orderstatus) > 1""")
def mixed_unit_discharged_by_key(t):
    return aggregates.mixed_units(t.orders, ["o_custkey", "o_orderstatus"], "o_orderstatus", "o_totalprice", scale=2)


@query("""select o_custkey, count(distinct o_orderstatus) as units, sum(o_totalprice::decimal(18,2))::double as mixed_total from orders where o_orderstatus = 'F' group by 1 having count(distinct o_orderstatus) > 1""")
def mixed_unit_discharged_by_pin(t):
    return aggregates.mixed_units(t.orders.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderstatus", "o_totalprice", scale=2)


@query("""with o as (select o_orderkey, o_totalprice from orders join lineitem on l_orderkey = o_orderkey)
select sum(m::decimal(18,2) * n)::double as as_summed, sum(m::decimal(18,2))::double as at_origin from (select max(o_totalprice) as m, count(*) as n from o group by o_orderkey)""")
def cross_model_fanout(t):
    return aggregates.grain_inflation(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")), "o_orderkey", "o_totalprice", scale=2)


_AGGREGATES = {
    "sum": ("sum(q)", lambda: F.sum(F.col("q"))), "count": ("count(*)", lambda: F.count("*")), "count_distinct": ("count(distinct q)", lambda: F.count_distinct("q")), "min": ("min(q)", lambda: F.min("q")), "max": ("max(q)", lambda: F.max("q")),
    "avg": ("round(avg(q::double), 6)", lambda: F.round(F.avg(F.col("q").cast("double")), 6)), "var_pop": ("round(var_pop(q::double), 4)", lambda: F.round(F.var_pop(F.col("q").cast("double")), 4)),
    "stddev_samp": ("round(stddev_samp(q::double), 4)", lambda: F.round(F.stddev_samp(F.col("q").cast("double")), 4)), "median": ("median(q::double)", lambda: F.median(F.col("q").cast("double"))),
    "percentile": ("quantile_cont(q::double, 0.9)", lambda: F.percentile(F.col("q").cast("double"), 0.9)), "count_if": ("count(*) filter (q > 25)", lambda: F.count_if(F.col("q") > 25)),
    "bool_and": ("bool_and(q > 0)::int", lambda: F.bool_and(F.col("q") > 0).cast("int")), "bool_or": ("bool_or(q > 49)::int", lambda: F.bool_or(F.col("q") > 49).cast("int")),
    "bit_and": ("bit_and(k)", lambda: F.bit_and("k")), "bit_or": ("bit_or(k)", lambda: F.bit_or("k")), "bit_xor": ("bit_xor(k)", lambda: F.bit_xor("k")), "min_by": ("min_by(k, q * 1000000000 + k)", lambda: F.min_by("k", F.col("q") * 1000000000 + F.col("k"))),
    "stddev": ("round(stddev(q::double), 4)", lambda: F.round(F.stddev(F.col("q").cast("double")), 4)), "stddev_pop": ("round(stddev_pop(q::double), 4)", lambda: F.round(F.stddev_pop(F.col("q").cast("double")), 4)),
    "variance": ("round(var_samp(q::double), 4)", lambda: F.round(F.variance(F.col("q").cast("double")), 4)), "kurtosis": ("round(kurtosis_pop(q::double), 4)", lambda: F.round(F.kurtosis(F.col("q").cast("double")), 4)),
    "skewness": ("round(skewness(q::double) * (count(q) - 2) / sqrt(count(q)::double * (count(q) - 1)), 4)", lambda: F.round(F.skewness(F.col("q").cast("double")), 4)),
    "mode": ("(list_sort(histogram(q).map_entries().list_transform(lambda e: {n: -e.value::bigint, q: e.key})))[1].q", lambda: F.mode("q", True)),
    "percentile_approx": ("quantile_disc(q, 0.9)", lambda: F.percentile_approx("q", 0.9, 1_000_000)), "percentile_cont": ("quantile_cont(q::double, 0.25)", lambda: F.expr("percentile_cont(0.25) within group (order by q)")), "percentile_disc": ("quantile_disc(q, 0.25)", lambda: F.expr("percentile_disc(0.25) within group (order by q)")),
    # which row's value they return is not fixed, but one of the input's it is
    **{name: (f"({name}(q) between min(q) and max(q))::int", lambda f=f: f("q").between(F.min("q"), F.max("q")).cast("int")) for name, f in (("any_value", F.any_value), ("first", F.first), ("last", F.last))},
    "approx_count_distinct": ("count(distinct q)", lambda: F.approx_count_distinct("q", 0.01)),
    "max_by": ("max_by(k, q * 1000000000 + k)", lambda: F.max_by("k", F.col("q") * 1000000000 + F.col("k"))), "sum_distinct": ("sum(distinct q)", lambda: F.sum_distinct("q")),
}
#: Aggregates that keep every value: made by blocks of rows, their sizes put together.
_HELD = {
    "collect_list": ("len(list(q))", lambda: F.size(F.collect_list("q")), F.sum),
    "listagg": ("length(string_agg(q::varchar, ','))", lambda: F.length(F.listagg(F.col("q").cast("string"), F.lit(","))), lambda n: F.sum(n) + F.count(n) - 1),
}
_BASE = "(select l_quantity::bigint as q, l_partkey as k from lineitem)"
_MORE = f"(select q, k from {_BASE}, range(1 + k % 3))"


@query(" union all ".join(f"select '{n}' as aggregate, (select ({s})::double from {_BASE}) as base, (select ({s})::double from {_MORE}) as duplicated" for n, (s, *_) in (_AGGREGATES | _HELD).items()))
def aggregate_duplication_effect(t):
    base = t.lineitem.select(F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").alias("k"))
    return aggregates.duplication_effect(base, {n: f() for n, (_, f) in _AGGREGATES.items()}, 1 + F.col("k") % 3, {n: (f(), whole) for n, (_, f, whole) in _HELD.items()})


# ---- contracts -------------------------------------------------------------------------------------------------


def _order_sums(t, factor: float = 1.0):
    own = Agg("sum", "o_totalprice", scale=2).of(t.orders).by("o_orderkey")
    return own, Agg("sum", F.col("l_extendedprice") * factor, scale=2).of(t.lineitem).by("l_orderkey")


_SUMS = """a as (select o_orderkey as k, sum(o_totalprice::decimal(18,2))::double as l from orders group by 1), b as (select l_orderkey as k, sum(l_extendedprice::decimal(18,2))::double as r from lineitem group by 1),
x as (select coalesce(a.k, b.k) as o_orderkey, coalesce(l, 0) as left_value, coalesce(r, 0) as right_value, l is null or r is null as one_side from a full join b on a.k = b.k)"""


@query(f"with {_SUMS} select o_orderkey, left_value, right_value from x where one_side or abs(left_value - right_value) > 0")
def conservation_exact(t):
    return violations(*_order_sums(t))


@query(f"with {_SUMS} select o_orderkey, left_value, right_value from x where one_side or abs(left_value - right_value) > 50000")
def conservation_tolerance(t):
    return violations(*_order_sums(t), within=50000.0)


@query(f"with {_SUMS} select o_orderkey, left_value, right_value from x where one_side or abs(left_value - right_value) > 0.5::double * abs(right_value)")
def conservation_relative(t):
    return violations(*_order_sums(t), relative=0.5)


@query(f"with {_SUMS}, c as (select l_orderkey as o_orderkey, sum(l_quantity::decimal(18,2))::double as q from lineitem group by 1) select o_orderkey, left_value, right_value from x left join c using (o_orderkey) where one_side or abs(left_value - right_value) > 1500 * coalesce(q, 0)")
def conservation_relative_to(t):
    return violations(*_order_sums(t), relative=1500.0, relative_to=Agg("sum", "l_quantity", scale=2).of(t.lineitem).by("l_orderkey"))


@query(f"with {_SUMS} select o_orderkey, left_value, right_value from x where one_side or not left_value <= right_value")
def conservation_at_most(t):
    return violations(*_order_sums(t), relation="<=")


@query("""with a as (select c_custkey as k, c_acctbal from customer), s as (select c_mktsegment as g, count(o_orderkey)::double as l from customer join orders on o_custkey = c_custkey group by 1),
r as (select c_mktsegment as g, count(distinct c_custkey)::double as r from customer group by 1) select s.g as c_mktsegment, l as left_value, r as right_value, l > r as holds from s full join r on s.g = r.g""")
def conservation_joined_on(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    left = Agg("count", "o_orderkey").of(t.customer).joined_on(o, "c_custkey").by("c_mktsegment")
    return compare(left, Agg("count_distinct", "c_custkey").of(t.customer).by("c_mktsegment"), ">")


# ---- set operations, grouping, findings ------------------------------------------------------------------------


@query("""select 'union all' as op, count(*) as n_rows, count(distinct k) as keys from (select c_nationkey as k from customer union all select s_nationkey from supplier)
union all select 'union', count(*), count(distinct k) from (select c_nationkey as k from customer union select s_nationkey from supplier)
union all select 'intersect', count(*), count(distinct k) from (select c_nationkey as k from customer intersect select s_nationkey from supplier)
union all select 'except', count(*), count(distinct k) from (select c_custkey as k from customer except select s_suppkey from supplier)""")
def set_op_keys(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    e = t.customer.select(F.col("c_custkey").alias("k")).subtract(t.supplier.select("s_suppkey"))
    out = None
    for name, df in (("union all", a.union(b)), ("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", e)):
        one = df.agg(F.count("*").alias("n_rows"), F.count_distinct("k").alias("keys")).select(F.lit(name).alias("op"), "n_rows", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity::decimal(18,2))::double as q from lineitem group by rollup(l_returnflag, l_linestatus)""")
def rollup_null_rows(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), total("l_quantity", scale=2).alias("q"))


@query("""select c_mktsegment, count(*) as n, count(*) filter (c_acctbal < 0) as overdrawn, sum(c_acctbal::decimal(18,2)) filter (c_acctbal > 0)::double as credit from customer group by 1 having count(*) > 1""")
def filtered_aggregates(t):
    x = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"), F.sum(F.when(F.col("c_acctbal") > 0, money("c_acctbal"))).cast("double").alias("credit"))
    return x.where("n > 1")


def _findings(t, line_keys: list[str], limit: float, world: str) -> DataFrame:
    """Findings of two checks: lines that break a key, by flag, and customers with an order above a limit."""
    broken = facts.key_violations(t.lineitem, line_keys).join(t.lineitem, line_keys)
    broken = broken.select(F.lit("audit").alias("family"), F.lit("join_fanout").alias("kind"), F.lit("lineitem").alias("model"), F.col("l_returnflag").alias("column_name"))
    large = t.orders.where(F.col("o_totalprice") > limit).select(F.lit("check").alias("family"), F.lit("contract_issue").alias("kind"), F.lit("orders").alias("model"), F.col("o_orderpriority").alias("column_name"))
    return broken.unionByName(large).distinct().withColumn("world", F.lit(world))


_FIND = """select distinct 'audit' as family, 'join_fanout' as kind, 'lineitem' as model, l_returnflag as column_name, '{w}' as world from lineitem join (select {k} from lineitem group by all having count(*) > 1) using ({k})
union all select distinct 'check', 'contract_issue', 'orders', o_orderpriority, '{w}' from orders where o_totalprice > {limit}"""
_FULL = _FIND.format(w="full", k="l_orderkey, l_linenumber", limit=0)
_STEADY = _FIND.format(w="steady", k="l_orderkey, l_partkey", limit=600000)


@query(f"with f as ({_FULL} union all {_STEADY}) select family, kind, model, column_name, case when kind = 'contract_issue' then 'error' else 'warn' end as severity, count(distinct world) as n_worlds from f group by all having count(distinct world) < 2")
def cross_world_strict_subset(t):
    f = _findings(t, ["l_orderkey", "l_linenumber"], 0, "full").unionByName(_findings(t, ["l_orderkey", "l_partkey"], 600000, "steady"))
    out = findings.only_in_some_worlds(f, ["full", "steady"]).withColumn("severity", findings.severity("kind"))
    return out.select("family", "kind", "model", "column_name", "severity", F.size("worlds").cast("long").alias("n_worlds"))


@query(f"with n as ({_FULL}), b as ({_STEADY}) select family, kind, model, column_name, world from n where not exists (select 1 from b where b.family = n.family and b.kind = n.kind and b.model = n.model and b.column_name = n.column_name)")
def baseline_introduced(t):
    return findings.introduced(_findings(t, ["l_orderkey", "l_linenumber"], 0, "full"), _findings(t, ["l_orderkey", "l_partkey"], 600000, "steady"))


@query(f"select count(*) as findings, count(*) filter (kind = 'contract_issue') as failing, count(*) filter (kind = 'contract_issue') = 0 as passed from ({_FULL})")
def gate(t):
    return findings.passes(_findings(t, ["l_orderkey", "l_linenumber"], 0, "full"))


@query("""with recursive e as (select distinct 'user ' || user_id as t, 'type ' || event_type as f from events union select distinct 'type ' || event_type, 'day ' || dayofweek(ts) from events),
c as (select t as node, f as ancestor from e union select c.node, e.f from c join e on c.ancestor = e.t)
select ancestor, count(*) as nodes from c where ancestor not in (select t from e) group by 1""")
def lineage_closure(t):
    e = t.events.select(F.concat(F.lit("user "), F.col("user_id")).alias("to_node"), F.concat(F.lit("type "), F.col("event_type")).alias("from_node"))
    e = e.unionByName(t.events.select(F.concat(F.lit("type "), F.col("event_type")).alias("to_node"), F.concat(F.lit("day "), F.dayofweek("ts") - 1).alias("from_node"))).distinct()
    return lineage.base_columns(e).groupBy(F.col("base").alias("ancestor")).agg(F.count("*").alias("nodes"))


@query("""select surrogate, count(*) as n from (select md5(concat_ws('-', coalesce(c_custkey::varchar, '_null_'), coalesce(c_mktsegment, '_null_'))) as surrogate from customer) group by 1""")
def surrogate_keys(t):
    return t.customer.groupBy(surrogate_key("c_custkey", "c_mktsegment").alias("surrogate")).agg(F.count("*").alias("n"))


# ---- range joins, functions and clauses ------------------------------------------------------------------------


@query("""select l, count(*) as parts from (select n_nationkey as l, n_nationkey + n_regionkey * 3 as h from nation) join part on p_size between l and h group by 1""")
def range_join_fanout(t):
    i = t.nation.select(F.col("n_nationkey").cast("long").alias("l"), (F.col("n_nationkey") + F.col("n_regionkey") * 3).cast("long").alias("h"))
    return joins.within_intervals(t.part.select("p_partkey", "p_size"), i, "p_size", "l", "h", 8).groupBy(F.col("l").cast("int").alias("l")).agg(F.count("*").alias("parts"))


@query("""select o_orderpriority as left_unit, l_returnflag as right_unit, count(*) as pairs from (select o_orderkey, case when o_totalprice > 100000 then 'R' else 'N' end as o_orderpriority from orders) join lineitem on l_orderkey = o_orderkey where o_orderpriority <> l_returnflag group by all""")
def join_key_unit_mismatch(t):
    o = t.orders.withColumn("unit", F.when(F.col("o_totalprice") > 100000, "R").otherwise("N"))
    return joins.key_unit_mismatch(o, t.lineitem, "o_orderkey", "l_orderkey", "unit", "l_returnflag")


@query("""select o_orderkey from orders where o_orderdate >= timestamp '1997-03-15 00:00:00' and not date_trunc('month', o_orderdate) >= timestamp '1997-03-01 00:00:00'""")
def date_trunc_implication(t):
    return facts.counterexamples(t.orders, F.expr("o_orderdate >= timestamp_ntz '1997-03-15 00:00:00'"), F.expr("date_trunc('month', o_orderdate) >= timestamp_ntz '1997-03-01 00:00:00'")).select("o_orderkey")


@query("""select count(*) as n_rows, count(k) as raw, count(coalesce(k, -1)) as with_default, count(coalesce(k, nullif(o_custkey % 2, 0))) as maybe, count(nullif(k, 3)) as nullified, count(k is null) as tested, count(k + 1) as added
from (select nullif(o_custkey % 6, 0) as k, o_custkey from orders)""")
def null_rules(t):
    x = t.orders.select(F.expr("nullif(o_custkey % 6, 0)").alias("k"), "o_custkey")
    n = lambda e, name: F.expr(f"count({e})").alias(name)
    return x.agg(n("*", "n_rows"), n("k", "raw"), n("coalesce(k, -1)", "with_default"), n("coalesce(k, nullif(o_custkey % 2, 0))", "maybe"), n("nullif(k, 3)", "nullified"), n("k is null", "tested"), n("k + 1", "added"))


@query("""select o_custkey, count(*) as n from orders group by 1 having count(*) > 15 and min(o_totalprice) > 1000""")
def having_clause(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least")).where("n > 15 and least > 1000").drop("least")


@query("""select c_custkey from customer where c_acctbal > (select avg(c_acctbal::decimal(18,2))::double from customer)""")
def scalar_subquery(t):
    mean = t.customer.agg((F.sum(money("c_acctbal")).cast("double") / F.count("c_acctbal")).alias("mean"))
    return t.customer.join(F.broadcast(mean)).where(F.col("c_acctbal") > F.col("mean")).select("c_custkey")  # one row


@query("""select l_returnflag, l_linestatus, grouping(l_returnflag)::int as g1, grouping(l_linestatus)::int as g2, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)""")
def cube_null_rows(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("""select o_orderpriority, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses, quantile_disc(o_totalprice, 0.5) as median_price from orders group by 1""")
def ordered_aggregates(t):
    statuses = F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses")
    x = t.orders.groupBy("o_orderpriority").agg(statuses)
    median = ordering.exact_percentiles(t.orders, ["o_orderpriority"], "o_totalprice", 0.5).select(F.col("o_orderpriority").alias("k"), F.col("percentile").alias("median_price"))
    return x.join(median, F.col("o_orderpriority").eqNullSafe(F.col("k")), "left").drop("k")


@query("""select doc_id, pos::int as pos, word from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from (select doc_id, string_split(text, ' ') as w from documents)) where length(word) > 14""")
def flatten_positions(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where(F.length("word") > 14)


@query("""select event_type, count(*) as empty_series from events where floor(value) - 40 < 1 group by 1""")
def series_emptiness(t):
    top = F.floor("value").cast("int") - 40
    series = F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
    return arrays.dropped_parents(t.events, series).groupBy("event_type").agg(F.count("*").alias("empty_series"))


@query("""select c_nationkey, c_mktsegment, count(*) as n from (select distinct c_nationkey, c_mktsegment from customer) group by all having count(*) > 1""")
def distinct_makes_key(t):
    return facts.key_violations(t.customer.select("c_nationkey", "c_mktsegment").distinct(), ["c_nationkey", "c_mktsegment"])


@query("""select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from (select user_id, event_type, count(*) as n from events group by all)) where r <= 2""")
def top_k_per_group(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


# ---- further joins, frames, sets and loads ---------------------------------------------------------------------


@query("""select o_orderstatus, count(*) as padded from (select c_custkey from customer join nation on n_nationkey = c_nationkey where c_acctbal > 5000) right join orders on o_custkey = c_custkey where c_custkey is null group by 1""")
def right_join_padding(t):
    left = t.customer.where("c_acctbal > 5000").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return joins.right_padding(left, t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("o_orderstatus").agg(F.count("*").alias("padded"))


@query("""select c_mktsegment, count(*) as pairs from orders join customer on o_custkey = c_custkey or o_orderkey = c_custkey group by 1""")
def or_join_fanout(t):
    x = joins.either(t.orders, t.customer, ("o_custkey", "c_custkey"), ("o_orderkey", "c_custkey"))
    return x.groupBy("right.c_mktsegment").agg(F.count("*").alias("pairs"))


@query("""select coalesce(m, 0) as matches, count(*) as left_rows from (select left(n_name, 1) as k from nation) left join (select left(c_mktsegment, 1) as k, count(*) as m from customer group by 1) using (k) group by 1""")
def function_join_fanout(t):
    return joins.fanout(t.nation, t.customer, F.substring("n_name", 1, 1), F.substring("c_mktsegment", 1, 1))


@query("""select (select count(*) from nation) as left_rows, (select count(*) from supplier) as right_rows, (select count(*) from nation, supplier) as pairs""")
def cross_join_size(t):
    return joins.cross_size(t.nation, t.supplier)


@query("""select o_custkey, arg_min_null(k, o_orderkey) as first, min_by(k, o_orderkey) as first_known from (select o_custkey, o_orderkey, case when o_orderkey % 3 <> 0 then o_orderkey end as k, case when o_orderkey % 3 <> 0 then 1 else 0 end as has from orders)
group by 1 having min_by(has, o_orderkey) = 0""")
def ignore_nulls_first(t):
    x = ordering.first_known(t.orders, ["o_custkey"], ["o_orderkey"], F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")))
    return x.where("first is null")


@query("""select o_custkey, count(*) as n_rows from orders group by 1 having count(*) filter (o_totalprice > 150000) = 0""")
def array_agg_ignore_nulls_empty(t):
    return arrays.collected_empty(t.orders, ["o_custkey"], F.when(F.col("o_totalprice") > 150000, F.col("o_orderkey")))


@query("""select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::bigint as level, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())""")
def grouping_sets_null_rows(t):
    return aggregates.grouping_set_rows(t.lineitem, [["l_returnflag"], ["l_linestatus"], []], ["l_returnflag", "l_linestatus"])


@query("""select l_returnflag, count(distinct l_partkey) as exact, true as close from lineitem group by 1""")
def sketch_estimates(t):
    return aggregates.sketch_error(t.lineitem, ["l_returnflag"], "l_partkey")


@query("""select c_nationkey, count(distinct c_mktsegment) as units, count(distinct c_custkey) as determinants from customer group by 1 having count(distinct c_mktsegment) > 1""")
def mixed_unit_by_coarse_key(t):
    return aggregates.discharged_by_dependency(t.customer, ["c_nationkey"], "c_custkey", "c_mktsegment")


@query("""select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as n_recent from events""")
def range_frame_counts(t):
    return ordering.recent_counts(t.events, ["user_id"], "ts", 86_400).select("event_id", "user_id", "n_recent")


@query("""select event_type, count(*) as n, count(k) as with_k, sum(k)::bigint as sum_k from (select event_type, regexp_extract(props, '"k": *([0-9]+)', 1) as t, case when regexp_extract(props, '"k": *([0-9]+)', 1) <> '' then regexp_extract(props, '"k": *([0-9]+)', 1)::bigint end as k from events) group by 1""")
def json_field_counts(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


@query("""select 'hash of the row' as claim, 0::bigint as only_first, 0::bigint as only_second from orders having count(*) > 0 union all select 'random key', count(*), count(*) from orders""")
def replay_differences(t):
    stable = replay.differences(lambda: t.orders.select(F.sha2("o_orderpriority", 256).alias("k"), "o_orderkey"))
    random = replay.differences(lambda: t.orders.select(F.expr("uuid()").alias("k"), "o_orderkey"))
    return stable.withColumn("claim", F.lit("hash of the row")).unionByName(random.withColumn("claim", F.lit("random key")))


@query("""with days as (select distinct ts::date as d from events where event_id % 11 = 0)
select (select count(*) from events where event_id % 11 <> 0 and ts::date not in (select d from days)) + (select count(*) from events where event_id % 11 = 0) as insert_overwrite_rows,
(select count(*) from events where event_id % 11 <> 0 and date_trunc('month', ts) not in (select date_trunc('month', ts) from events where event_id % 11 = 0)) + (select count(*) from events where event_id % 11 = 0) as microbatch_rows""")
def incremental_partition_loads(t):
    x = t.events.withColumn("day", F.to_date("ts")).withColumn("month", F.date_trunc("month", "ts"))
    n = lambda s, part, name: incremental.load(x.where("event_id % 11 <> 0"), x.where("event_id % 11 = 0"), s, ["event_id"], [], part).agg(F.count("*").alias(name))
    return n("insert_overwrite", "day", "insert_overwrite_rows").join(F.broadcast(n("microbatch", "month", "microbatch_rows")))


@query("""select count(*) filter (k <> 3) as other, count(*) filter (k in (1, 2)) as listed, count(*) filter (k not in (1, 2)) as not_listed, count(*) filter (k between 1 and 3) as within, count(*) filter (p like '1-%') as alike, count(*) filter (p not like '1-%') as unlike,
count(*) filter (k is null) as unknown, count(*) as n_rows from (select nullif(o_custkey % 5, 0) as k, nullif(o_orderpriority, '5-LOW') as p from orders)""")
def null_intolerant_predicates(t):
    x = t.orders.select(F.expr("nullif(o_custkey % 5, 0)").alias("k"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"))
    k, p = F.col("k"), F.col("p")
    tests = {"other": k != 3, "listed": k.isin(1, 2), "not_listed": ~k.isin(1, 2), "within": k.between(1, 3), "alike": p.like("1-%"), "unlike": ~p.like("1-%"), "unknown": k.isNull()}
    return x.agg(*(F.count_if(c).alias(n) for n, c in tests.items()), F.count("*").alias("n_rows"))


@query(f"select doc_id, pos::int as pos, element from (select doc_id, unnest(case when coalesce(len(w), 0) = 0 then [null] else w end) as element, case when coalesce(len(w), 0) = 0 then null else generate_subscripts(w, 1) - 1 end as pos from (select doc_id, {_LONG_WORDS} as w from documents))")
def flatten_outer_rows(t):
    return arrays.outer_elements(t.documents, ["doc_id"], _long_words())


@query("""select kind, count(*) as n, sum(amount)::double as amount from (select unnest(['discount', 'tax']) as kind, unnest([(l_discount * 100)::bigint, (l_tax * 100)::bigint]) as amount from lineitem) group by 1""")
def inline_structs(t):
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.round(F.col(c) * 100).cast("long").alias("amount")) for k, c in (("discount", "l_discount"), ("tax", "l_tax"))))
    return t.lineitem.select(F.inline(pairs)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


_FACTS = [
    ("orders", "unique", ["o_orderkey"], None, None, None, None, "constraint"), ("lineitem", "unique", ["l_orderkey", "l_linenumber"], None, None, None, None, "test"), ("orders", "unique", ["o_custkey"], None, None, None, "o_totalprice > 400000", "test"),
    ("orders", "not_null", ["o_orderdate"], None, None, None, None, "test"), ("orders", "relationships", ["o_custkey"], None, "customer", "c_custkey", None, "test"), ("orders", "accepted_values", ["o_orderpriority"], ["1-URGENT", "2-HIGH"], None, None, None, "test"),
    ("customer", "not_null", ["c_phone"], None, None, None, None, "test"), ("payments", "unique", ["id"], None, None, None, None, "incremental"),
]
_FACT_ROWS = """(select * from (values ('orders', 'o_orderkey', 'unique', 'constraint', 'checked', (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1))),
('lineitem', 'l_orderkey,l_linenumber', 'unique', 'test', 'checked', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))),
('orders', 'o_custkey', 'unique', 'test', 'checked', (select count(*) from (select 1 from orders where o_totalprice > 400000 group by o_custkey having count(*) > 1))),
('orders', 'o_orderdate', 'not_null', 'test', 'checked', (select count(*) from orders where o_orderdate is null)), ('orders', 'o_custkey', 'relationships', 'test', 'checked', (select count(*) from orders where o_custkey not in (select c_custkey from customer))),
('orders', 'o_orderpriority', 'accepted_values', 'test', 'checked', (select count(distinct o_orderpriority) from orders where o_orderpriority not in ('1-URGENT', '2-HIGH'))),
('customer', 'c_phone', 'not_null', 'test', 'no column c_phone', null), ('payments', 'id', 'unique', 'incremental', 'no such relation', null)) as v(model, column_name, property, provenance, status, broken))"""


def _declared(t):
    return t.spark.createDataFrame(_FACTS, "model string, property string, columns array<string>, accepted array<string>, parent string, parent_column string, condition string, provenance string")


def _relation(t):
    return lambda name: getattr(t, name) if name in ("orders", "lineitem", "customer") else None


@query(f"select 'check' as family, 'contract_issue' as kind, model, column_name, property, provenance, status, broken from {_FACT_ROWS}")
def declared_facts_checked(t):
    return project.check(_declared(t), _relation(t))


@query(f"""select model, count(*) as declared, count(*) filter (status = 'checked') as checked, count(*) filter (status = 'checked') / count(*) as share, case when count(*) filter (status = 'checked') / count(*) < 0.5 then 'resolution_below_floor' end as kind
from {_FACT_ROWS} group by 1""")
def fact_coverage(t):
    return project.analyze(_declared(t), _relation(t), floor=0.5)[1]


@query("""with a as (select l_orderkey as k, sum(l_extendedprice * (1 - l_discount)) as l from lineitem where l_returnflag in ('A', 'N') group by 1), b as (select l_orderkey as k, sum(l_extendedprice) as r from lineitem where l_quantity between 1 and 50 group by 1)
select coalesce(a.k, b.k) as l_orderkey, round(coalesce(l, 0), 3) as left_value, round(coalesce(r, 0), 3) as right_value from a full join b on a.k = b.k where l is null or r is null or not l <= r - 1000""")
def conservation_of_expressions(t):
    left = Agg("sum", F.col("l_extendedprice") * (1 - F.col("l_discount"))).of(t.lineitem).where(F.col("l_returnflag").isin("A", "N")).by("l_orderkey")
    right = Agg("sum", "l_extendedprice").of(t.lineitem).where(F.col("l_quantity").between(1, 50)).by("l_orderkey")
    x = violations(left, right, "<=", within=-1000.0)
    return x.select("l_orderkey", F.round("left_value", 3).alias("left_value"), F.round("right_value", 3).alias("right_value"))
from rowproof import catalog_checks, catalog_measures, catalog_projects  # noqa: E402, F401  register their queries
