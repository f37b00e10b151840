"""The query catalogue: each of the engine's operators over the shared tables, with the SQL that checks it."""

from __future__ import annotations

import datetime
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera import sources, streaming, types
from tessera.engine import Engine
from tessera.operators import joins, merge, partition
from tessera.operators.merge import Agg
from tessera.plans import analyze, classify, contains_scan, deal, parallelism, partition_info, passes_plan_gate, passes_text_gate
from tessera.session import TABLES

#: Declared orders that differ from the alphabet's.
EVENT_TYPES = ("view", "click", "signup", "purchase", "error")
SEGMENTS = ("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def by_text(name: str, text: str, oracle: str | None = None) -> None:
    """A query that Spark SQL answers as it stands; oracle: the same text unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name], ORACLE[name] = run, oracle or text


# scans

@query("scan_project", "select o_orderkey, o_custkey, o_totalprice from orders")
def scan_project(spark, d):
    return sources.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("scan_filtered", "select l_orderkey, l_quantity from lineitem where l_shipdate < timestamp '1997-01-01' and l_quantity > 45")
def scan_filtered(spark, d):
    return sources.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_shipdate < timestamp_ntz '1997-01-01' and l_quantity > 45")


@query("scan_page", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 50 offset 100")
def scan_page(spark, d):
    return sources.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, 100)


@query("scan_missing_table", "select r_regionkey, r_name from region where false")
def scan_missing_table(spark, d):
    return sources.table_or_empty(spark, "no_such_table_anywhere", "r_regionkey int, r_name string")


@query("scan_sql_text", "select n_regionkey, count(*) as n from nation group by n_regionkey")
def scan_sql_text(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return sources.text_scan(spark, "select n_regionkey, count(*) as n from nation group by n_regionkey")


@query("series_range", "select range::bigint as i, (range * 100)::bigint as value, (range % 5)::bigint as bucket from range(10, 2000)")
def series_range(spark, d):
    return sources.series(spark, 10, 2000, name="i").select("i", (F.col("i") * 100).alias("value"), (F.col("i") % 5).alias("bucket"))


@query("literal_rows", "select * from (values (1, 'a', true), (2, null, false), (3, 'c', null)) v(id, name, ok)")
def literal_rows(spark, d):
    return sources.literal_rows(spark, [(1, "a", True), (2, None, False), (3, "c", None)], "id int, name string, ok boolean")


@query("arrow_round_trip", "select r_regionkey, r_name from region")
def arrow_round_trip(spark, d):
    return sources.from_arrow(spark, sources.to_arrow(table(spark, d, "region").select("r_regionkey", "r_name")))


# filters and expressions

by_text("filter_compare", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 49 and l_returnflag <> 'N' and l_linenumber < 3")
by_text("filter_between", "select o_orderkey, o_totalprice from orders where o_totalprice between 1000.0 and 50000.0")
by_text("filter_in", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
by_text("filter_or", "select o_orderkey from orders where o_orderstatus = 'F' or (o_totalprice > 200000 and o_orderpriority = '1-URGENT')")
by_text("filter_null", "select o_orderkey, nullif(o_orderstatus, 'P') as st from orders where nullif(o_orderstatus, 'P') is null")
by_text("filter_not_null", "select count(*) as n from orders where nullif(o_orderstatus, 'F') is not null")
by_text("filter_like", "select p_partkey, p_name from part where p_name like '%a%' and p_brand like 'Brand#1%'")
by_text("filter_time", "select event_id, ts from events where ts >= timestamp '2024-01-05 12:00:00' and ts < timestamp '2024-01-06'", "select event_id, ts from events where ts >= timestamp '2024-01-05 12:00:00' and ts < timestamp '2024-01-06'")
by_text("case_expr", "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, case c_mktsegment when 'BUILDING' then 1 else 0 end as b from customer")
by_text("exists_scalar", "select exists (select 1 from orders where o_totalprice > 100000000) as huge, exists (select 1 from orders where o_totalprice > 1000) as some_orders")
by_text("exists_filter", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
by_text("string_concat", "select p_partkey, 'Item ' || cast(p_partkey as string) as label from part", "select p_partkey, 'Item ' || p_partkey::varchar as label from part")
by_text("cast_decimal", "select o_orderkey, cast(o_orderkey * 1.5 as decimal(10,2)) as amount from orders", "select o_orderkey, (o_orderkey * 1.5)::decimal(10,2) as amount from orders")
by_text("modulo_math", "select o_orderkey, o_orderkey % 5 as bucket, o_orderkey * 100 as value, o_orderkey + 1 as next from orders")
by_text("octet_length", "select p_partkey, cast(octet_length(p_name) as bigint) as n, cast(octet_length('é' || p_name) as bigint) as m from part", "select p_partkey, octet_length(encode(p_name)) as n, octet_length(encode('é' || p_name)) as m from part")
by_text("json_get", "select event_id, cast(get_json_object(props, '$.k') as bigint) as k from events", "select event_id, cast(props->>'$.k' as bigint) as k from events")

# aggregates

by_text("agg_ungrouped", "select count(*) as n, round(sum(l_extendedprice), 2) as s, round(avg(l_quantity), 6) as a, min(l_shipdate) as lo, max(l_shipdate) as hi, min(l_quantity) as lq, max(l_extendedprice) as hp from lineitem")
by_text("agg_grouped", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as s, round(avg(l_discount + 0.0), 6) as a from lineitem group by l_returnflag, l_linestatus")
by_text("agg_decimal", "select l_returnflag, cast(sum(cast(l_extendedprice as decimal(12,2))) as decimal(38,2)) as s, round(cast(avg(cast(l_extendedprice as decimal(12,2))) as double), 3) as a, min(cast(l_tax as decimal(10,2))) as lo, max(cast(l_tax as decimal(10,2))) as hi from lineitem group by l_returnflag")
by_text("agg_filtered", "select o_orderpriority, count(*) as n from orders where o_orderdate >= timestamp '1997-01-01' group by o_orderpriority")
by_text("agg_null_keys", "select nullif(o_orderstatus, 'F') as st, count(*) as n, round(sum(o_totalprice), 2) as s from orders group by nullif(o_orderstatus, 'F')")
by_text("agg_empty_input", "select count(*) as n, sum(o_custkey) as s, max(o_totalprice) as m from orders where o_orderkey < 0", "select count(*) as n, sum(o_custkey)::bigint as s, max(o_totalprice) as m from orders where o_orderkey < 0")
by_text("having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15")
by_text("count_distinct", "select count(distinct o_custkey) as custs, count(distinct o_orderpriority) as prios, count(*) as n from orders")
by_text("count_distinct_grouped", "select l_returnflag, count(distinct l_suppkey) as supps from lineitem group by l_returnflag")
by_text("select_distinct", "select distinct p_brand, p_size from part")
by_text("rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)")
by_text("cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube(o_orderstatus, o_orderpriority)")
by_text("grouping_sets", "select p_brand, p_size, count(*) as n from part group by grouping sets ((p_brand), (p_size), ())")


@query("sum_types", "select sum(l_linenumber)::decimal(38,0) as whole, sum(l_extendedprice::decimal(28,2)) as money, round(avg(l_linenumber), 6) as mean from lineitem")
def sum_types(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(fn.sum_whole("l_linenumber").cast("decimal(38,0)").alias("whole"), fn.sum_money("l_extendedprice").alias("money"), F.round(fn.avg_double("l_linenumber"), 6).alias("mean"))


# ENUMs

LIST = "[" + ", ".join(f"'{x}'" for x in EVENT_TYPES) + "]"
SEGMENT_LIST = "[" + ", ".join(f"'{x}'" for x in SEGMENTS) + "]"


@query("enum_min_max", f"select user_id, cast(ts as date) as day, min_by(event_type, list_position({LIST}, event_type)) as lo, max_by(event_type, list_position({LIST}, event_type)) as hi from events group by all")
def enum_min_max(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(fn.enum_min("event_type", EVENT_TYPES).alias("lo"), fn.enum_max("event_type", EVENT_TYPES).alias("hi"))


@query("enum_order", f"select c_custkey, c_mktsegment, row_number() over (order by list_position({SEGMENT_LIST}, nullif(c_mktsegment, 'HOUSEHOLD')) nulls last, c_custkey) as place from customer")
def enum_order(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("e"), F.floor(F.col("c_custkey") / 4096).alias("g"))
    return partition.in_order(c, {"e": fn.enum_order("e", SEGMENTS), "g": F.asc("g")}, F.asc("c_custkey"), "place").drop("e", "g")


@query("enum_compare", f"select event_id, event_type from events where list_position({LIST}, event_type) > list_position({LIST}, 'click') and list_position({LIST}, event_type) <= 4")
def enum_compare(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return e.where(fn.enum_compare("event_type", ">", F.lit("click"), EVENT_TYPES) & fn.enum_compare("event_type", "<=", F.lit("purchase"), EVENT_TYPES))


by_text("enum_group_in_distinct", "select c_mktsegment, count(*) as n from customer where c_mktsegment in ('BUILDING', 'FURNITURE') group by c_mktsegment")

# order, limits, sets

by_text("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 20")
by_text("limit_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 25")
by_text("order_by_ordinal", "select o_custkey, o_orderkey from orders order by 1, 2 limit 30")


@query("order_nulls_last", "select o_orderkey, nullif(o_orderstatus, 'F') as st, row_number() over (order by nullif(o_orderstatus, 'F') desc nulls last, o_orderkey) as place from orders")
def order_nulls_last(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("st"), F.floor(F.col("o_orderkey") / 4096).alias("g"))
    return partition.in_order(o, {"st": fn.nulls_last("st", descending=True), "g": F.asc("g")}, F.asc("o_orderkey"), "place").drop("g")


by_text("set_union", "select c_nationkey as k from customer where c_acctbal < 0 union select s_nationkey from supplier")
by_text("set_union_all", "select c_nationkey as k from customer union all select s_nationkey from supplier")
by_text("set_intersect", "select o_custkey as k from orders where o_totalprice > 250000 intersect select c_custkey from customer where c_acctbal > 5000")
by_text("set_except", "select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 150000")

# joins

by_text("join_inner", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 200000")
by_text("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000 group by c_custkey")
by_text("join_full", "select coalesce(a.k, b.k) as k, a.n as n, b.m as m from (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by c_nationkey) a full outer join (select s_nationkey as k, count(*) as m from supplier where s_acctbal > 5000 group by s_nationkey) b on a.k = b.k")
by_text("join_semi", "select c_custkey from customer left semi join (select o_custkey from orders where o_totalprice > 280000) o on c_custkey = o_custkey", "select c_custkey from customer semi join (select o_custkey from orders where o_totalprice > 280000) o on c_custkey = o_custkey")
by_text("join_anti", "select c_custkey from customer left anti join (select o_custkey from orders where o_totalprice > 50000) o on c_custkey = o_custkey", "select c_custkey from customer anti join (select o_custkey from orders where o_totalprice > 50000) o on c_custkey = o_custkey")
by_text("join_theta", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey < r.r_regionkey")
by_text("join_cross", "select r.r_name, n.n_name from region r cross join nation n")
by_text("join_inequality", "select s.s_suppkey, count(*) as n from supplier s join nation n on s.s_nationkey >= n.n_nationkey and s.s_acctbal > n.n_nationkey * 300 group by s.s_suppkey")


@query("join_asof", """
select v.event_id, v.user_id, p.value as last_value from (select * from events where event_type = 'click') v
asof left join (select user_id, ts, value from events where event_type = 'view') p on v.user_id = p.user_id and v.ts >= p.ts""")
def join_asof(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"))
    return joins.asof_join(left, right, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "user_id", "last_value")


@query("join_range", "select o_orderkey, p_partkey from orders join part on o_totalprice >= p_retailprice * 100 and o_totalprice < p_retailprice * 100 + 1")
def join_range(spark, d):
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 1).alias("hi"))
    return joins.interval_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), parts, "o_totalprice", "lo", "hi", 2.0).select("o_orderkey", "p_partkey")


# lists

by_text("list_unnest", "select vec_id, explode(slice(embedding, 1, 3)) as x from embeddings", "select vec_id, unnest(embedding[1:3]) as x from embeddings")


@query("list_len", "select vec_id, len(embedding) as n, len(case when label = 1 then null else embedding[1:label] end) as m from embeddings")
def list_len(spark, d):
    e = table(spark, d, "embeddings")
    some = F.when(F.col("label") != 1, F.slice("embedding", F.lit(1), F.greatest("label", F.lit(0))))
    return e.select("vec_id", fn.list_len("embedding").alias("n"), fn.list_len(some).alias("m"))


@query("list_get", "select vec_id, embedding[1] as first, embedding[64] as last, embedding[65] as beyond, embedding[-1] as back from embeddings")
def list_get(spark, d):
    return table(spark, d, "embeddings").select("vec_id", fn.list_get("embedding", 1).alias("first"), fn.list_get("embedding", 64).alias("last"), fn.list_get("embedding", 65).alias("beyond"), fn.list_get("embedding", -1).alias("back"))


@query("list_contains", "select vec_id, list_contains([nullif(label, 3), 1], 3) as three, list_contains([label, 1], 1) as one from embeddings")
def list_contains(spark, d):
    label = F.col("label")
    return table(spark, d, "embeddings").select("vec_id", fn.list_contains(F.array(F.nullif(label, F.lit(3)), F.lit(1)), 3).alias("three"), fn.list_contains(F.array(label, F.lit(1)), 1).alias("one"))


@query("list_literals", "select [1, 2, null]::varchar as i, len([1, 2, null]) as n, [1, 2, null][2] as second, ([date '2024-01-01', date '2024-02-29'][2])::varchar as d, len([]::varchar[]) as e, strftime([timestamp '2024-01-01 10:00:00'][1], '%H:%M') as t")
def list_literals(spark, d):
    day, moment = datetime.date, datetime.datetime
    l = sources.literal_rows(spark, [([1, 2, None], [day(2024, 1, 1), day(2024, 2, 29)], [], [moment(2024, 1, 1, 10)])], "i array<int>, d array<date>, e array<string>, t array<timestamp_ntz>")
    written = F.concat(F.lit("["), F.array_join("i", ", ", "NULL"), F.lit("]"))
    return l.select(written.alias("i"), fn.list_len("i").alias("n"), fn.list_get("i", 2).alias("second"), fn.list_get("d", 2).cast("string").alias("d"), fn.list_len("e").alias("e"), F.date_format(fn.list_get("t", 1), "HH:mm").alias("t"))


# types

@query("types_unsigned", "select event_id::ubigint::decimal(20,0) as u64, (event_id % 256)::utinyint::smallint as u8, (event_id % 65536)::usmallint::integer as u16, event_id::uinteger::bigint as u32 from events")
def types_unsigned(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(types.checked(i, "UBIGINT").alias("u64"), types.checked(i % 256, "UTINYINT").alias("u8"), types.checked(i % 65536, "USMALLINT").alias("u16"), types.checked(i, "UINTEGER").alias("u32"))


@query("types_wide", "select event_id, (event_id::hugeint * 10000000000000000000::hugeint * 1000000000000 - 5)::varchar as big from events")
def types_wide(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id").cast("decimal(10,0)") * F.lit("10000000000000").cast("decimal(14,0)")).cast("decimal(24,0)").alias("x"))
    big = F.when(F.col("x") == 0, F.lit("-5")).otherwise(F.concat(((F.col("x") * 10 - 1).cast("decimal(26,0)")).cast("string"), F.lit("99999999999999995")))
    return e.select("event_id", types.wide_number(types.wide_text(big)).alias("big"))


@query("types_wide_order", "select event_id, (event_id::hugeint - 50)::varchar as v, row_number() over (order by event_id::hugeint - 50 desc) as place from events")
def types_wide_order(spark, d):
    e = table(spark, d, "events").select("event_id", types.wide_text(F.col("event_id") - 50).alias("w")).withColumn("g", F.substring("w", 1, types.WIDE - 2))
    return partition.in_order(e, {"g": F.desc("g")}, F.desc("w"), "place").select("event_id", types.wide_number(F.col("w")).alias("v"), "place")


@query("types_time", "select event_id, epoch_us(ts) % 86400000000 as micros, strftime(ts, '%H:%M:%S') as clock from events")
def types_time(spark, d):
    clock = F.date_format("ts", "HH:mm:ss")
    fraction = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000))
    micros = types.time_micros(clock) + fraction
    return table(spark, d, "events").select("event_id", micros.alias("micros"), F.substring(types.time_text(micros), 1, 8).alias("clock"))


@query("types_interval", "select event_id from events where to_days((event_id % 60)::integer) > interval 1 month")
def types_interval(spark, d):
    e = table(spark, d, "events").select("event_id", F.struct(F.lit(0).alias("months"), (F.col("event_id") % 60).cast("int").alias("days"), F.lit(0).cast("long").alias("micros")).alias("i"))
    return e.where(types.interval_micros(F.col("i")) > types.interval_micros(types.interval(months=1))).select("event_id")


@query("types_uuid", "select event_id, lower(upper('550E8400-E29B-41D4-A716-' || lpad(event_id::varchar, 12, '0')))::uuid::varchar as u from events")
def types_uuid(spark, d):
    text = F.concat(F.lit("550E8400-E29B-41D4-A716-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return table(spark, d, "events").select("event_id", types.checked(text, "UUID").alias("u"))


# windows and CTEs

by_text("window_rank", "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rn, cast(rank() over (partition by o_orderpriority order by o_orderkey) as bigint) as rk from orders")
by_text("window_frames", "select event_id, lag(value) over (partition by user_id order by ts) as prev, round(sum(value) over (partition by user_id order by ts rows between 2 preceding and current row), 4) as s from events")
by_text("cte", "with big as (select * from orders where o_totalprice > 250000), n as (select o_custkey, count(*) as n from big group by o_custkey) select c_custkey, n from customer join n on c_custkey = o_custkey")
by_text("cte_recursive", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 100) select n, n * n as sq from t")

# partitioning and merging

AGGS = [Agg("count", "*", "n"), Agg("sum", "cast(l_extendedprice as decimal(14,2))", "s"), Agg("min", "l_quantity", "lo"), Agg("max", "l_quantity", "hi"), Agg("avg", "l_linenumber", "a"), Agg("count_distinct", "l_suppkey", "supps")]
AGG_SQL = "select l_returnflag, l_linestatus, count(*) as n, sum(l_extendedprice::decimal(14,2))::decimal(38,2) as s, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_linenumber), 6) as a, count(distinct l_suppkey) as supps from lineitem group by l_returnflag, l_linestatus"


def dealt(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_linenumber", "l_suppkey", F.col("_metadata"))
        parts = partition.partitioned(li, partition.STRATEGIES[strategy](4))
        out = merge.two_step(parts, partition.PART, ["l_returnflag", "l_linestatus"], AGGS)
        return out.withColumns({"s": F.col("s").cast("decimal(38,2)"), "a": F.round("a", 6)})

    return run


for strategy in partition.STRATEGIES:
    QUERIES[f"part_{strategy}"], ORACLE[f"part_{strategy}"] = dealt(strategy), AGG_SQL


@query("merge_ungrouped", "select count(*) as n, sum(l_extendedprice::decimal(14,2))::decimal(38,2) as s, round(avg(l_quantity), 6) as a, count(distinct l_partkey) as parts from lineitem where l_returnflag = 'R' or l_quantity > 40")
def merge_ungrouped(spark, d):
    li = table(spark, d, "lineitem").select("*", F.col("_metadata")).where("l_returnflag = 'R' or l_quantity > 40")
    parts = partition.partitioned(li, partition.modulo_part(7))
    out = merge.two_step(parts, partition.PART, [], [Agg("count", "*", "n"), Agg("sum", "cast(l_extendedprice as decimal(14,2))", "s"), Agg("avg", "l_quantity", "a"), Agg("count_distinct", "l_partkey", "parts")])
    return out.withColumns({"s": F.col("s").cast("decimal(38,2)"), "a": F.round("a", 6)})


@query("merge_distinct", "select distinct l_returnflag, l_linenumber from lineitem")
def merge_distinct(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", F.col("_metadata"))
    return merge.distinct_merge(partition.partitioned(li, partition.modulo_part(5)).select(partition.PART, "l_returnflag", "l_linenumber"), partition.PART)


@query("merge_concat", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 or o_orderstatus = 'P'")
def merge_concat(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("_metadata")).where("o_totalprice > 100000 or o_orderstatus = 'P'")
    parts = partition.partitioned(o, partition.modulo_part(3))
    return merge.concatenate(parts.select(partition.PART, "o_orderkey", "o_totalprice"), partition.PART)


# tables

def engine(spark: SparkSession) -> Engine:
    """An engine whose tables lie in a fresh folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return Engine(spark, f"{base.rstrip('/')}/tables-{datetime.datetime.now().timestamp():.6f}")


def loaded(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark)
    e.sql("CREATE TABLE o (o_orderkey BIGINT, o_custkey BIGINT, st VARCHAR, o_totalprice DOUBLE)")
    e.store.insert("o", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")), "o_totalprice"))
    return e


@query("insert_select", "select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as st, o_totalprice from orders union all select -c_custkey, c_custkey, null, null from customer where c_acctbal < 0")
def insert_select(spark, d):
    e = loaded(spark, d)
    e.store.insert("o", table(spark, d, "customer").where("c_acctbal < 0").select(-F.col("c_custkey"), "c_custkey"), ["o_orderkey", "o_custkey"])
    return e.sql("SELECT * FROM dh.o")


@query("delete_predicate", "select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as st, o_totalprice from orders where (nullif(o_orderstatus, 'P') = 'F' or o_totalprice > 200000) is not true")
def delete_predicate(spark, d):
    e = loaded(spark, d)
    e.sql("DELETE FROM dh.o WHERE st = 'F' OR o_totalprice > 200000")
    return e.sql("SELECT * FROM dh.o")


@query("update_predicate", "select o_orderkey, o_custkey, case when o_totalprice < 5000 then 'S' else nullif(o_orderstatus, 'P') end as st, case when o_totalprice < 5000 then 0 else o_totalprice end as o_totalprice from orders")
def update_predicate(spark, d):
    e = loaded(spark, d)
    e.sql("UPDATE dh.o SET st = 'S', o_totalprice = 0 WHERE o_totalprice < 5000")
    return e.sql("SELECT * FROM dh.o")


@query("alter_add_default", "select o_orderkey, 'active' as status, null::integer as score from orders union all select -1, 'late', 7")
def alter_add_default(spark, d):
    e = loaded(spark, d)
    e.sql("ALTER TABLE dh.o ADD COLUMN status VARCHAR DEFAULT 'active'")
    e.sql("ALTER TABLE dh.o ADD COLUMN IF NOT EXISTS score INTEGER")
    e.sql("INSERT INTO dh.o (o_orderkey, status, score) VALUES (-1, 'late', 7)")
    return e.sql("SELECT o_orderkey, status, score FROM dh.o")


@query("rename_drop_column", "select o_orderkey as id, o_totalprice from orders")
def rename_drop_column(spark, d):
    e = loaded(spark, d)
    for s in ("RENAME COLUMN o_orderkey TO id", "DROP COLUMN st", "DROP COLUMN IF EXISTS nothing", "DROP COLUMN o_custkey"):
        e.sql(f"ALTER TABLE dh.o {s}")
    e.sql("ALTER TABLE dh.o RENAME TO p")
    return e.sql("SELECT * FROM dh.p")


@query("alter_type", "select o_orderkey::integer as o_orderkey, o_totalprice::decimal(12,1) as o_totalprice from orders")
def alter_type(spark, d):
    e = loaded(spark, d)
    e.sql("ALTER TABLE dh.o ALTER COLUMN o_orderkey TYPE INTEGER")
    e.sql("ALTER TABLE dh.o ALTER o_totalprice SET DATA TYPE DECIMAL(12,1)")
    return e.sql("SELECT o_orderkey, o_totalprice FROM dh.o")


@query("create_table_as", "select o_custkey, count(*) as n from orders group by o_custkey")
def create_table_as(spark, d):
    e = loaded(spark, d)
    e.sql("CREATE TABLE dh.totals AS SELECT o_custkey, COUNT(*) AS n FROM dh.o GROUP BY o_custkey")
    return e.sql("SELECT * FROM totals")


@query("enum_table", "select * from (values (1, 'happy'), (3, 'sad'), (4, 'neutral'), (2, null)) v(id, m)")
def enum_table(spark, d):
    e = engine(spark)
    e.sql("CREATE TYPE mood AS ENUM ('happy', 'sad', 'neutral')")
    e.sql("CREATE TABLE dh.moods (id INTEGER, m mood)")
    e.sql("INSERT INTO dh.moods VALUES (1, 'happy'), (2, NULL), (3, 'sad'), (4, 'neutral')")
    return e.sql("SELECT * FROM dh.moods")


@query("index_metadata", "select * from (values ('dh', 'main', 'o_by_cust', 'o'), ('dh', 'main', 'o_by_key', 'o')) v(database_name, schema_name, index_name, table_name)")
def index_metadata(spark, d):
    e = loaded(spark, d)
    for s in ("CREATE INDEX o_by_key ON dh.o(o_orderkey)", "CREATE INDEX o_by_cust ON dh.o(o_custkey, st)", "CREATE INDEX gone ON dh.o(st)", "DROP INDEX gone", "DROP INDEX IF EXISTS gone"):
        e.sql(s)
    return e.sql("SELECT database_name, schema_name, index_name, table_name FROM dh_indexes() WHERE table_name = 'o'")


@query("table_exists", "select * from (values ('o', true), ('missing', false)) v(name, there)")
def table_exists(spark, d):
    e = loaded(spark, d)
    return spark.createDataFrame([(n, e.store.exists(n)) for n in ("o", "missing")], "name string, there boolean")


@query("table_list", "select 'o' as table_name, count(*) as estimated_size, 4::integer as column_count from orders")
def table_list(spark, d):
    return loaded(spark, d).sql("SELECT table_name, estimated_size, column_count FROM dh_tables()")


@query("engine_lists", "select o_orderkey, len(l) as n, l[1] as first, l[-1] as back, l[9] as beyond, l[2:3]::varchar as middle, list_contains(l, 2) as two, len(st) as letters from (select o_orderkey, nullif(o_orderstatus, 'P') as st, [o_orderkey % 4, 2, null, o_custkey] as l from orders) where len(l) > 2 and not list_contains(l, 3)")
def engine_lists(spark, d):
    e = loaded(spark, d)
    e.sql("CREATE TABLE dh.lists (k BIGINT, st VARCHAR, l BIGINT[])")
    e.sql("INSERT INTO dh.lists SELECT o_orderkey, st, [o_orderkey % 4, 2, NULL, o_custkey] FROM dh.o")
    return e.sql("SELECT k AS o_orderkey, cast(len(l) AS BIGINT) AS n, l[1] AS first, l[-1] AS back, l[9] AS beyond, concat('[', array_join(l[2:3], ', ', 'NULL'), ']') AS middle, list_contains(l, 2) AS two, cast(len(st) AS BIGINT) AS letters FROM dh.lists WHERE len(l) > 2 AND NOT list_contains(l, 3)")


@query("engine_unnest", "select o_orderkey, unnest([o_orderkey, o_custkey]) as x from orders where o_orderkey in (select max(o_orderkey) from orders group by o_custkey)")
def engine_unnest(spark, d):
    return loaded(spark, d).sql("SELECT o_orderkey, unnest([o_orderkey, o_custkey]) AS x FROM dh.o WHERE o_orderkey IN (SELECT MAX(o_orderkey) FROM dh.o GROUP BY o_custkey)")


@query("delete_subquery", "select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as st, o_totalprice from orders where o_custkey not in (select o_custkey from orders group by 1 having sum(o_totalprice) > 2000000) and o_totalprice <= (select avg(o_totalprice) * 2 from orders)")
def delete_subquery(spark, d):
    e = loaded(spark, d)
    e.sql("CREATE TABLE dh.big AS SELECT o_custkey FROM dh.o GROUP BY o_custkey HAVING SUM(o_totalprice) > 2000000")
    e.sql("DELETE FROM dh.o WHERE o_custkey IN (SELECT o_custkey FROM dh.big) OR o_totalprice > (SELECT AVG(o_totalprice) * 2 FROM dh.o)")
    return e.sql("SELECT * FROM dh.o")


@query("update_subquery", "select o_orderkey, o_custkey, case when exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0) then 'N' else nullif(o_orderstatus, 'P') end as st, case when exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0) then (select max(o_totalprice) from orders) else o_totalprice end as o_totalprice from orders")
def update_subquery(spark, d):
    e = loaded(spark, d)
    e.sql("CREATE TABLE dh.c (c_custkey BIGINT, c_acctbal DOUBLE)")
    e.store.insert("c", table(spark, d, "customer").select("c_custkey", "c_acctbal"))
    e.sql("UPDATE dh.o SET st = 'N', o_totalprice = (SELECT MAX(o_totalprice) FROM dh.o) WHERE EXISTS (SELECT 1 FROM dh.c WHERE c.c_custkey = o.o_custkey AND c_acctbal < 0)")
    return e.sql("SELECT * FROM dh.o")


@query("views", "select o_custkey, n, total from (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice > 100000 group by o_custkey) where n > 1")
def views(spark, d):
    e = loaded(spark, d)
    e.sql("CREATE VIEW dh.dear AS SELECT * FROM dh.o WHERE o_totalprice > 150000")
    e.sql("CREATE OR REPLACE VIEW dh.dear AS SELECT * FROM dh.o WHERE o_totalprice > 100000")
    e.sql("CREATE TEMP VIEW totals AS SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM dear GROUP BY o_custkey")
    return e.sql("SELECT * FROM totals WHERE n > 1")


@query("schemas", "select o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey where o_totalprice > 300000")
def schemas(spark, d):
    e = loaded(spark, d)
    e.sql("CREATE SCHEMA dh.crm")
    e.sql("CREATE TABLE dh.crm.o (c_custkey BIGINT)")
    e.store.insert("crm.o", table(spark, d, "customer").select("c_custkey"))
    return e.sql("SELECT o_orderkey, c_custkey FROM dh.o JOIN dh.crm.o AS c ON o_custkey = c_custkey WHERE o_totalprice > 300000")


by_text("set_intersect_all", "select o_custkey from orders where o_totalprice > 100000 intersect all select o_custkey from orders where o_orderstatus <> 'F'")
by_text("set_except_all", "select o_custkey from orders except all select o_custkey from orders where o_orderstatus = 'F'")
by_text("agg_lists", "select o_custkey, array_join(array_sort(collect_list(o_orderkey)), ',') as orders, array_join(array_sort(collect_set(o_orderstatus)), '') as states from orders group by o_custkey", "select o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') as orders, array_to_string(list_sort(list(distinct o_orderstatus)), '') as states from orders group by o_custkey")


@query("agg_approximate", "select event_type, true as near_count, true as near_median from events group by event_type")
def agg_approximate(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"), F.approx_percentile("value", 0.5, 10_000).alias("p"), F.percentile("value", 0.5).alias("q"), F.stddev("value").alias("s"))
    return e.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.08 * F.col("n") + 1).alias("near_count"), (F.abs(F.col("p") - F.col("q")) <= 0.05 * F.col("s") + 1e-9).alias("near_median"))


@query("insert_arrow", "select c_custkey, c_name from customer")
def insert_arrow(spark, d):
    e = engine(spark)
    e.sql("CREATE TABLE dh.c (c_custkey BIGINT, c_name VARCHAR)")
    e.insert_arrow("c", sources.to_arrow(table(spark, d, "customer").select("c_custkey", "c_name")))
    return e.sql("SELECT * FROM dh.c")


@query("alter_constraints", "select * from (values (1, 'a', true), (2, 'x', true), (3, 'x', false)) v(id, s, nullable)")
def alter_constraints(spark, d):
    e = engine(spark)
    e.sql("CREATE TABLE dh.t (id INTEGER, s VARCHAR)")
    e.sql("INSERT INTO dh.t VALUES (1, 'a')")
    e.sql("ALTER TABLE dh.t ALTER COLUMN s SET DEFAULT 'x'")
    e.sql("INSERT INTO dh.t (id) VALUES (2)")
    e.sql("ALTER TABLE dh.t ALTER COLUMN s SET NOT NULL")
    refused = False
    try:
        e.sql("INSERT INTO dh.t VALUES (9, NULL)")
    except Exception as error:
        refused = "NOT NULL constraint failed" in str(error)
    e.sql("INSERT INTO dh.t (id) VALUES (3)")
    return e.sql("SELECT * FROM dh.t").withColumn("nullable", (F.col("id") < 3) | F.lit(not refused))


@query("control_functions", "select * from (values ('attached', 'h:99'), ('cleared', '0'), ('extension', 'true'), ('stopped', '0'), ('workers', '2')) v(what, result)")
def control_functions(spark, d):
    e = engine(spark)
    out = []
    e.sql("ATTACH 'dh' (TYPE any, server_host 'h', server_port 99)")
    out.append(("attached", f"{e.server['host']}:{e.server['port']}"))
    e.sql("SELECT start_local_server(8815)")
    e.sql("SELECT start_standalone_worker(9101)")
    e.sql("SELECT register_worker('w', 'grpc://a:1')")
    out.append(("workers", str(e.sql("SELECT get_worker_count()").first()[0])))
    out.append(("extension", str(e.sql("SELECT load_extension('json')").first()[0]).lower()))
    e.sql("CREATE TABLE dh.a (i INTEGER)")
    e.sql("SELECT clear_query_recorder_stats()")
    out.append(("cleared", str(e.sql("SELECT * FROM get_query_history()").count())))
    e.sql("SELECT stop_local_server()")
    out.append(("stopped", str(e.sql("SELECT get_worker_count()").first()[0])))
    return spark.createDataFrame(out, "what string, result string")


@query("plan_fields", "select * from (values ('group', true, true, false, false, 1::bigint), ('join', false, false, true, false, 2), ('window', false, false, false, true, 2)) v(what, has_aggregation, has_group_by, has_join, has_window, pipelines)")
def plan_fields(spark, d):
    for t in ("nation", "region"):
        table(spark, d, t).createOrReplaceTempView(t)
    texts = {"group": "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "join": "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey", "window": "SELECT rank() OVER (ORDER BY n_name) AS r FROM nation"}
    rows = [(what, (a := analyze(spark.sql(t))).has_aggregation, a.has_group_by, a.has_join, a.has_window, a.pipelines) for what, t in texts.items()]
    return spark.createDataFrame(rows, "what string, has_aggregation boolean, has_group_by boolean, has_join boolean, has_window boolean, pipelines long")


@query("partition_facts", "select * from (values (50::bigint, 13::bigint, false, 1::bigint, 1::bigint, 'NONE'), (200000, 50000, true, 2, 1, 'NATURAL'), (500000, 125000, true, 5, 2, 'ROW_GROUP_ALIGNED'), (5000000, 1250000, true, 41, 20, 'ROW_GROUP_ALIGNED')) v(n_rows, each, worthwhile, row_groups, threads, strategy)")
def partition_facts(spark, d):
    rows = [(n, (i := partition_info(n, 4))["rows_per_partition"], i["worthwhile"], i["row_groups"], parallelism(n), deal(n, 4, parallelism(n)).strategy) for n in (50, 200_000, 500_000, 5_000_000)]
    return spark.createDataFrame(rows, "n_rows long, each long, worthwhile boolean, row_groups long, threads long, strategy string")


@query("file_formats", "select r_regionkey, r_name, 'csv' as kind from region union all select r_regionkey, r_name, 'json' from region union all select r_regionkey, r_name, 'orc' from region union all select r_regionkey, r_name, 'parquet' from region")
def file_formats(spark, d):
    base = engine(spark).store.root
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    out = None
    for kind in ("csv", "json", "orc", "parquet"):
        region.write.format(kind).option("header", True).save(f"{base}/{kind}")
        read = spark.read.format(kind).schema("r_regionkey long, r_name string").option("header", True).load(f"{base}/{kind}").withColumn("kind", F.lit(kind))
        out = read if out is None else out.union(read)
    return out


@query("exec_stats", "select * from (values ('DELEGATED', 'GROUP_BY_MERGE', 4::bigint, 1::bigint), ('LOCAL', 'CONCATENATE', 4, 1), ('DELEGATED', 'AGGREGATE_MERGE', 4, 1)) v(execution_mode, merge_strategy, num_workers_used, num_tasks_generated)")
def exec_stats(spark, d):
    e = engine(spark)
    e.sql("SELECT start_local_server(8815, 4)")
    e.sql("CREATE TABLE dh.r (k INTEGER, name VARCHAR)")
    e.store.insert("r", table(spark, d, "region"))
    for s in ("SELECT name, COUNT(*) AS n FROM dh.r GROUP BY name", "SELECT * FROM dh.r ORDER BY k", "SELECT COUNT(*) AS n FROM dh.r WHERE k > 1"):
        e.execute(s)
    return e.sql("SELECT execution_mode, merge_strategy, num_workers_used, num_tasks_generated FROM get_query_execution_stats()")


@query("query_history", "select * from (values ('CREATE TABLE dh.a (i INTEGER)', 1::bigint), ('DROP TABLE dh.a', 1)) v(query, runs)")
def query_history(spark, d):
    e = engine(spark)
    e.sql("CREATE TABLE dh.a (i INTEGER)")
    e.sql("INSERT INTO dh.a VALUES (1)")
    e.sql("DROP TABLE dh.a")
    return e.sql("SELECT query, cast(array_size(latencies) AS bigint) AS runs FROM get_query_history()")


@query("remote_registry", "select * from (values ('worker_count', '2'), ('again', 'Failed to register table t because it''s already registered!'), ('unknown', 'Failed to unregister table x because it hasn''t been registered!'), ('resolved', '3')) v(what, result)")
def remote_registry(spark, d):
    e = engine(spark)
    out = []
    for s in ("SELECT start_local_server(8815)", "SELECT register_worker('w1', 'grpc://a:1')", "SELECT register_worker('w2', 'grpc://b:2')", "SELECT register_or_replace_driver('d', 'grpc://c:3')"):
        e.sql(s)
    out.append(("worker_count", str(e.sql("SELECT get_worker_count()").first()[0])))
    e.sql("PRAGMA register_remote_table('t', 'target')")
    for what, s in (("again", "PRAGMA register_remote_table('t', 'target')"), ("unknown", "PRAGMA unregister_remote_table('x')")):
        try:
            e.sql(s)
        except ValueError as error:
            out.append((what, str(error)))
    e.sql("CREATE TABLE dh.t (i INTEGER)")
    e.sql("INSERT INTO dh.t VALUES (1), (2), (3)")
    out.append(("resolved", str(e.store.row_count("target"))))
    return spark.createDataFrame(out, "what string, result string")


@query("mode_table", "select * from (values (0::bigint, 'DELEGATED', 1::bigint), (10000, 'DELEGATED', 1), (122879, 'DELEGATED', 1), (200000, 'NATURAL_PARTITION', 4), (250000, 'NATURAL_PARTITION', 4), (500000, 'ROW_GROUP_PARTITION', 3)) v(n_rows, mode, tasks)")
def mode_table(spark, d):
    return spark.createDataFrame([(n, (x := deal(n, 4)).mode, x.tasks) for n in (0, 10_000, 122_879, 200_000, 250_000, 500_000)], "n_rows long, mode string, tasks long")


@query("plan_gates", """
select * from (values ('filter', true, true, 'DELEGATED', 'CONCATENATE'), ('order', false, false, 'LOCAL', 'CONCATENATE'), ('join', true, false, 'LOCAL', 'CONCATENATE'),
('group', true, true, 'DELEGATED', 'GROUP_BY_MERGE'), ('distinct', true, true, 'DELEGATED', 'DISTINCT_MERGE'), ('window', false, false, 'LOCAL', 'CONCATENATE')) v(what, text_gate, plan_gate, mode, merge)""")
def plan_gates(spark, d):
    for t in ("nation", "region"):
        table(spark, d, t).createOrReplaceTempView(t)
    texts = {
        "filter": "SELECT n_name FROM nation WHERE n_regionkey = 1",
        "order": "SELECT n_name FROM nation ORDER BY n_name",
        "join": "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "group": "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey",
        "distinct": "SELECT DISTINCT n_regionkey FROM nation",
        "window": "SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation",
    }
    rows = []
    for what, text in texts.items():
        df = spark.sql(text)
        assert contains_scan(df)
        rows.append((what, passes_text_gate(text), passes_plan_gate(df), classify(text, df, 25, 4).mode, analyze(df).merge_strategy))
    return spark.createDataFrame(rows, "what string, text_gate boolean, plan_gate boolean, mode string, merge string")


# streams (beyond parity)

@query("events_windowed", "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_windowed(spark, d):
    return streaming.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


# the three shapes that are timed against a single node

def generated(spark: SparkSession, rows: int) -> DataFrame:
    i = F.col("id")
    category = F.element_at(F.array(*map(F.lit, ("electronics", "clothing", "food", "books", "furniture"))), (i % 5 + 1).cast("int"))
    return spark.range(rows).select(i.cast("int").alias("id"), (i * 100).cast("int").alias("value"), category.alias("category"), (i * F.lit(1.5)).cast("decimal(10,2)").alias("amount"))


CATEGORY = "case range % 5 when 0 then 'electronics' when 1 then 'clothing' when 2 then 'food' when 3 then 'books' else 'furniture' end"


@query("bench_small", "select count(*) as n, sum(range * 100)::bigint as s, round(avg(range * 1.5), 4) as a from range(1000)")
def bench_small(spark, d):
    return generated(spark, 1000).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.round(fn.avg_double("amount"), 4).alias("a"))


@query("bench_medium", f"select {CATEGORY} as category, count(*) as n, sum(range * 100)::bigint as s, round(avg(range * 1.5), 4) as a from range(200000) group by 1")
def bench_medium(spark, d):
    return generated(spark, 200_000).groupBy("category").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.round(fn.avg_double("amount"), 4).alias("a"))


@query("bench_large", f"select {CATEGORY} as category, count(*) as n, sum(range * 100)::bigint as s from range(500000) group by 1")
def bench_large(spark, d):
    return generated(spark, 500_000).groupBy("category").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
