"""Catalogs, overlays, lookups, checks, digests and set operations over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spoolwave.operators import catalog, integrity
from spoolwave.operators.ranking import ranked
from spoolwave.plans import overlay
from spoolwave.plans.tables import micros, table
from spoolwave.queries.registry import query


@query("p03_only", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def p03(spark, sf):
    wanted = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return catalog.only(table(spark, sf, "orders"), wanted, "o_custkey").select("o_orderkey", "o_custkey")


_SPEC = [("*", True, "series", "acquired", None), ("Brand#1", False, None, "own", "first"), ("Brand#2", None, "table", None, None), ("Brand#3", True, "units", "x", "third")]
_SPEC_SQL = "(values ('*', true, 'series', 'acquired', null), ('Brand#1', false, null, 'own', 'first'), ('Brand#2', null, 'table', null, null), ('Brand#3', true, 'units', 'x', 'third')) s(key, include, type, description, out_name)"


def _spec(spark):
    return spark.createDataFrame(_SPEC, "key string, include boolean, type string, description string, out_name string")


@query("p04_include", f"select p_partkey from part left join (select * from {_SPEC_SQL}) o on o.key = p_brand, (select include from {_SPEC_SQL} where key = '*') d where coalesce(o.include, d.include, true)")
def p04(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("key"))
    return catalog.with_spec(rows, _spec(spark), "key", ["include"]).where(F.coalesce("include", F.lit(True))).select("p_partkey")


@query("p06_spec_merge", f"select p_partkey, p_brand, coalesce(o.include, d.include) as include, coalesce(o.type, d.type) as type, o.out_name from part left join (select * from {_SPEC_SQL}) o on o.key = p_brand, (select * from {_SPEC_SQL} where key = '*') d")
def p06(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("key"))
    return catalog.with_spec(rows, _spec(spark), "key", ["include", "type"], ["out_name"]).withColumnRenamed("key", "p_brand")


@query("p05_minimal_flags", "select c_custkey as key, c_acctbal > 0 as flag from customer where (c_acctbal > 0) is distinct from (c_mktsegment <> 'MACHINERY')")
def p05(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 0).alias("flag"), "c_mktsegment")
    return catalog.minimal_flags(c, "key", "flag", F.col("c_mktsegment") != "MACHINERY")


@query("p10_signal_role", "select p_partkey, case when p_name like '%bolt' then 'sync' when p_type = 'PROMO' or p_size > 40 then 'analog' else 'electrode' end as role from part")
def p10(spark, sf):
    role = F.when(F.col("p_name").endswith("bolt"), "sync").when((F.col("p_type") == "PROMO") | (F.col("p_size") > 40), "analog").otherwise("electrode")
    return table(spark, sf, "part").select("p_partkey", role.alias("role"))


@query("p12_looks_electrical", "select l_orderkey, count(*) >= 4 and max(l_extendedprice) >= 10000 as electrical from lineitem group by 1")
def p12(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(((F.count("*") >= 4) & (F.max("l_extendedprice") >= 10000)).alias("electrical"))


@query("p13_null_like", "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as z from customer")
def p13(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("z"))


@query("p18_duplicates", "select p_name, p_brand, count(*) as n from part group by 1, 2 having count(*) > 1")
def p18(spark, sf):
    return catalog.repeated(table(spark, sf, "part").select("p_name", "p_brand"), ["p_name", "p_brand"])


@query("p19_unknown_keys", "select distinct l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')")
def p19(spark, sf):
    return catalog.unknown(table(spark, sf, "lineitem"), table(spark, sf, "orders").where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey")


@query("p20_stream_key", "select p_partkey, concat_ws('|', coalesce(p_brand, ''), coalesce(p_type, ''), coalesce(nullif(p_size, 7)::varchar, '')) as key from part")
def p20(spark, sf):
    key = F.concat_ws("|", F.coalesce("p_brand", F.lit("")), F.coalesce("p_type", F.lit("")), F.coalesce(F.nullif(F.col("p_size"), F.lit(7)).cast("string"), F.lit("")))
    return table(spark, sf, "part").select("p_partkey", key.alias("key"))


@query("p23_unknown_gain", "select l_orderkey, l_linenumber, l_extendedprice, bool_or(nullif(l_discount, 0.0) is null) over (partition by l_orderkey) as uncalibrated from lineitem")
def p23(spark, sf):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.bool_or(F.nullif(F.col("l_discount"), F.lit(0.0)).isNull()).over(w).alias("uncalibrated"))


@query("p24_event_target", "select l_orderkey, case when count(distinct l_linenumber) = 1 then 'table' else 'series' end as target from lineitem group by 1")
def p24(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(catalog.event_target(F.count_distinct("l_linenumber")).alias("target"))


@query("p25_subject", "select c_custkey, coalesce(case when c_mktsegment = 'HOUSEHOLD' then 'F' end, case when c_acctbal < 0 then 'M' end, 'U') as sex from customer")
def p25(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", overlay.subject_sex(F.when(F.col("c_mktsegment") == "HOUSEHOLD", "F"), F.when(F.col("c_acctbal") < 0, "M")).alias("sex"))


@query(
    "j01_channel_electrode",
    "with f as (select l_suppkey, min(l_partkey) as electrode from lineitem where l_quantity > 48 group by 1) select s_suppkey, s_name, electrode from supplier left join f on l_suppkey = s_suppkey",
)
def j01(spark, sf):
    links = table(spark, sf, "lineitem").where("l_quantity > 48").groupBy("l_suppkey").agg(F.min("l_partkey").alias("electrode"))
    s = table(spark, sf, "supplier")
    return s.join(links, s.s_suppkey == links.l_suppkey, "left").select("s_suppkey", "s_name", "electrode")


@query("j02_lookup_first", "select p_name, p_partkey, p_size from (select *, row_number() over (partition by p_name order by p_partkey) as k from part) where k = 1")
def j02(spark, sf):
    return catalog.first_by(table(spark, sf, "part").select("p_name", "p_partkey", "p_size"), ["p_name"], ["p_partkey"]).select("p_name", "p_partkey", "p_size")


@query(
    "j03_upsert",
    """with d as (select o_custkey as k, max(o_orderstatus) as g from orders where o_orderpriority = '1-URGENT' group by 1), p as (select c_custkey as k, c_mktsegment as g, c_name from customer where c_mktsegment <> 'MACHINERY')
    select p.k, coalesce(d.g, p.g) as g, c_name from p left join d using (k) union all select d.k, d.g, null from d where d.k not in (select k from p)""",
)
def j03(spark, sf):
    d = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderstatus").alias("g"))
    p = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("g"), "c_name")
    return catalog.upsert(p, d, "k", "g")


@query(
    "j04_impedance",
    """with t as (select c_nationkey, max(c_acctbal) as z from customer where c_acctbal >= 0 group by 1) select s_suppkey, coalesce(case when s_acctbal > 5000 then s_acctbal end, z * 1000) as ohms from supplier left join t on c_nationkey = s_nationkey""",
)
def j04(spark, sf):
    t = table(spark, sf, "customer").where("c_acctbal >= 0").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("z"))
    s = table(spark, sf, "supplier")
    return s.join(t, s.s_nationkey == t.c_nationkey, "left").select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")), F.col("z") * 1000).alias("ohms"))


@query(
    "j05_snippet_electrode",
    "with e as (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier) select c_custkey, e.s_suppkey as electrode from customer left join e on s_nationkey = c_nationkey and k = c_custkey % 3 + 1",
)
def j05(spark, sf):
    e = table(spark, sf, "supplier").withColumn("k", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    c = table(spark, sf, "customer")
    return c.join(e, (e.s_nationkey == c.c_nationkey) & (e.k == c.c_custkey % 3 + 1), "left").select("c_custkey", F.col("s_suppkey").alias("electrode"))


@query(
    "j06_group_replace",
    """with r as (select n_nationkey as k, n_name as name, 'dev' || n_regionkey as device from nation where n_nationkey < 20), d as (select n_nationkey as k, 'declared ' || n_name as name, case when n_nationkey % 2 = 0 then 'new' end as device from nation where n_nationkey >= 10)
    select coalesce(d.k, r.k) as k, case when d.k is null then r.name else d.name end as name, coalesce(d.device, r.device) as device from d full outer join r on d.k = r.k""",
)
def j06(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "k")
    r = n.where("k < 20").select("k", F.col("n_name").alias("name"), F.concat(F.lit("dev"), F.col("n_regionkey").cast("string")).alias("device"))
    d = n.where("k >= 10").select("k", F.concat(F.lit("declared "), "n_name").alias("name"), F.when(F.col("k") % 2 == 0, "new").alias("device"))
    return catalog.replace_groups(r, d, "k", "device")


@query(
    "j09_prefer",
    "select o_custkey as k, 'order' as src from orders where o_orderstatus = 'F' union all select c_custkey, 'customer' from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
)
def j09(spark, sf):
    from spoolwave.operators.pairing import preferred

    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit("order").alias("src"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("src"))
    return preferred(a, b, "k")


@query("j10_offline_codes", "select v.vec_id, coalesce(l.quality + 100, v.label) as code from embeddings v left join labels l on l.doc_id = v.vec_id")
def j10(spark, sf):
    from spoolwave.operators.pairing import overlay_codes

    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("code"))
    codes = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") + 100).alias("q"))
    return overlay_codes(rows, codes, "vec_id", "q", "code")


@query("j11_shared_electrodes", "select l_partkey, l_suppkey, list_sort(list(distinct l_orderkey)) as links from lineitem where l_quantity > 40 group by 1, 2")
def j11(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 40").groupBy("l_partkey", "l_suppkey").agg(F.array_sort(F.collect_set("l_orderkey")).alias("links"))


@query("j17_clock_by_prefix", "select p_partkey, coalesce(a.r_regionkey, b.r_regionkey) as clock from part left join region a on a.r_regionkey = p_size left join region b on starts_with(p_type, left(b.r_name, 1))")
def j17(spark, sf):
    p, a = table(spark, sf, "part"), table(spark, sf, "region")
    own = a.select(F.col("r_regionkey").alias("own"))
    pre = a.select(F.col("r_regionkey").alias("pre"), F.substring("r_name", 1, 1).alias("c"))
    return p.join(F.broadcast(own), F.col("own") == F.col("p_size"), "left").join(F.broadcast(pre), F.substring("p_type", 1, 1) == F.col("c"), "left").select("p_partkey", F.coalesce("own", "pre").alias("clock"))


@query("j18_missing_data", "select n_nationkey, count(c_custkey) as n, count(c_custkey) = 0 as missing from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by 1")
def j18(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer").where("c_acctbal > 9000")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"), (F.count("c_custkey") == 0).alias("missing"))


@query("j19_devices", "select distinct 'dev' || c_nationkey % 7 as device from customer where 'dev' || c_nationkey % 7 not in (select 'dev' || r_regionkey from region)")
def j19(spark, sf):
    dev = lambda c: F.concat(F.lit("dev"), c.cast("string"))
    return catalog.unknown(table(spark, sf, "customer").select(dev(F.col("c_nationkey") % 7).alias("device")), table(spark, sf, "region").select(dev(F.col("r_regionkey")).alias("name")), "device", "name")


@query(
    "j20_referential_checks",
    """select 'error' as level, 'unknown part' as message, 'lineitem' as target_kind, l_partkey::varchar as target_name from (select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size < 45))
    union all select 'warning', 'repeated line', 'lineitem', l_orderkey || ':' || l_linenumber from lineitem group by l_orderkey, l_linenumber having count(*) > 2""",
)
def j20(spark, sf):
    line = table(spark, sf, "lineitem")
    return overlay.validate(line, table(spark, sf, "part").where("p_size < 45"), "l_partkey", "p_partkey", ["l_orderkey", "l_linenumber"], 2)


@query(
    "j22_line_up",
    """with f as (select l_suppkey, l_returnflag, count(*) as n, min(l_orderkey) as a, max(l_orderkey) as b from lineitem group by 1, 2),
    g as (select *, first_value(n) over w as n0, first_value(a) over w as a0 from f window w as (partition by l_suppkey order by l_returnflag))
    select l_suppkey, l_returnflag, abs(n - n0) <= 60 and a <= a0 + 100 as fits from g""",
)
def j22(spark, sf):
    f = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("a"))
    w = Window.partitionBy("l_suppkey").orderBy("l_returnflag")
    fits = (F.abs(F.col("n") - F.first("n").over(w)) <= 60) & (F.col("a") <= F.first("a").over(w) + 100)
    return f.select("l_suppkey", "l_returnflag", fits.alias("fits"))


@query(
    "j23_shared_group",
    "select s_suppkey, n - 1 as others, case when n > 1 then case when s_suppkey = low then second else low end end as first_other from (select *, count(*) over w as n, min(s_suppkey) over w as low, nth_value(s_suppkey, 2) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and unbounded following) as second from supplier window w as (partition by s_nationkey))",
)
def j23(spark, sf):
    w = Window.partitionBy("s_nationkey")
    full = w.orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = table(spark, sf, "supplier").withColumn("n", F.count("*").over(w)).withColumn("low", F.min("s_suppkey").over(w)).withColumn("second", F.nth_value("s_suppkey", 2).over(full))
    other = F.when(F.col("n") > 1, F.when(F.col("s_suppkey") == F.col("low"), F.col("second")).otherwise(F.col("low")))
    return s.select("s_suppkey", (F.col("n") - 1).alias("others"), other.alias("first_other"))


@query("j26_sibling_metadata", "select l_orderkey, l_linenumber, l_extendedprice, max(case when l_linenumber = 1 then l_shipdate end) over (partition by l_orderkey) as sites from lineitem")
def j26(spark, sf):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.max(F.when(F.col("l_linenumber") == 1, F.col("l_shipdate"))).over(w).alias("sites"))


@query("j27_probe_letter", "select c_custkey, n_name from customer join (select n_name, row_number() over (order by n_nationkey) - 1 as k from nation) on k = ascii(c_mktsegment) - 65")
def j27(spark, sf):
    n = table(spark, sf, "nation").withColumn("k", F.row_number().over(Window.orderBy("n_nationkey")) - 1)
    return table(spark, sf, "customer").join(F.broadcast(n), F.col("k") == F.ascii("c_mktsegment") - 65).select("c_custkey", "n_name")


@query("j29_describe", "select p_partkey, concat_ws('; ', p_name || ' (' || p_type || ')', case when p_size > 25 then p_brand end) as said from part")
def j29(spark, sf):
    said = F.concat_ws("; ", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), F.when(F.col("p_size") > 25, F.col("p_brand")))
    return table(spark, sf, "part").select("p_partkey", said.alias("said"))


@query("a09_stored_bytes", "select l_orderkey, sum(l_quantity::bigint * l_linenumber * 2)::bigint as bytes from lineitem group by 1")
def a09(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint") * F.col("l_linenumber") * 2).alias("bytes"))


_LINE = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint, l_returnflag)"
_BLOCKS = f"(select l_orderkey // 500 as block, count(*) as n, sha256(string_agg({_LINE}, chr(10) order by {_LINE})) as digest from lineitem %s group by 1)"

_KEPT = "where not (l_returnflag = 'R' and l_quantity = 50) and l_orderkey >= 500"
_LATE = "where l_shipdate >= timestamp '1998-01-01'"


def _said():
    return F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("bigint").cast("string"), "l_returnflag")


def _blocks(line):
    return integrity.block_digests(line.select(F.expr("l_orderkey div 500").alias("block"), _said().alias("said")), ["block"], [], F.col("said"))


@query("a19_block_digest", f"select * from {_BLOCKS % ''}")
def a19(spark, sf):
    return _blocks(table(spark, sf, "lineitem"))


@query("a19_overall_digest", f"select sha256(string_agg(digest, '' order by block)) as digest from {_BLOCKS % ''}")
def a19_overall(spark, sf):
    return integrity.overall_digest(_blocks(table(spark, sf, "lineitem")), [], "block")


_STATES = f"(select coalesce(a.block, b.block) as block, case when b.digest is null then 'missing' when a.digest is null then 'extra' when a.digest = b.digest then 'ok' else 'differs' end as state from {_BLOCKS % ''} a full outer join {_BLOCKS % _KEPT} b on a.block = b.block)"


def _states(spark, sf):
    line = table(spark, sf, "lineitem")
    return integrity.compare(_blocks(line), _blocks(line.where("not (l_returnflag = 'R' and l_quantity = 50) and l_orderkey >= 500")), ["block"])


@query("v07_verify", f"select block, state from {_STATES}")
def v07(spark, sf):
    return _states(spark, sf)


@query("a20_mismatches", f"select 'lineitem' as path, count(*) as blocks, count(*) filter (state <> 'ok') as mismatches, list_slice(list(block order by block) filter (state <> 'ok'), 1, 5) as first from {_STATES} having count(*) filter (state <> 'ok') > 0")
def a20(spark, sf):
    return integrity.mismatch_summary(_states(spark, sf).withColumn("path", F.lit("lineitem")), "path", "block")


@query("v08_recheck", f"select block, digest from {_BLOCKS % _LATE}")
def v08(spark, sf):
    """Digests of blocks read back from a store that was written first."""
    from spoolwave.sources.store import read_store, write_store

    line = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01'")
    path = write_store(line, "recheck", chunk=F.expr("l_orderkey div 500"))
    return _blocks(read_store(spark, path)).select("block", "digest")


@query("v10_report", f"select 'blocks ' || string_agg(block, ', ' order by block) as said from (select block from {_STATES} where state <> 'ok' order by block limit 5)")
def v10(spark, sf):
    s = integrity.mismatch_summary(_states(spark, sf).withColumn("path", F.lit("lineitem")), "path", "block")
    return s.select(F.concat(F.lit("blocks "), F.array_join(F.transform("first", lambda b: b.cast("string")), ", ")).alias("said"))


@query("v15_close", "select p_partkey, abs(p_retailprice - p_retailprice * (1 + p_size * 1e-6)) <= 1e-5 * abs(p_retailprice * (1 + p_size * 1e-6)) as same from part")
def v15(spark, sf):
    other = F.col("p_retailprice") * (1 + F.col("p_size") * 1e-6)
    return table(spark, sf, "part").select("p_partkey", integrity.close(F.col("p_retailprice"), other).alias("same"))


@query("a21_issue_counts", "select level, count(*) as n from (select case when l_quantity > 45 then 'error' else 'warning' end as level from lineitem where l_quantity > 40) group by 1")
def a21(spark, sf):
    level = F.when(F.col("l_quantity") > 45, "error").otherwise("warning")
    return table(spark, sf, "lineitem").where("l_quantity > 40").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("v17_blocked", "select string_agg(p_brand, ', ' order by pos, p_brand) as reason from (select p_brand, min(p_partkey) as pos from part where p_size > 48 group by 1)")
def v17(spark, sf):
    issues = table(spark, sf, "part").select(F.when(F.col("p_size") > 48, "error").otherwise("warning").alias("level"), F.col("p_brand").alias("target_name"), F.col("p_partkey").alias("pos"))
    return catalog.blocked_reason(issues, "pos")


@query("v12_channel_sets", "select c_nationkey, list(c_custkey order by c_custkey) as channels from customer group by 1")
def v12(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("channels"))


@query("v13_rows", "select e.event_id, (epoch_us(e.ts) - 1704067200000000) / 1e6 as onset, value as duration from events e where event_type = 'purchase'")
def v13(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", ((micros("ts") - 1704067200000000) / 1e6).alias("onset"), F.col("value").alias("duration"))


@query("a23_numeric_columns", "select unnest(['conv', 'role', 'digits']) as name, unnest([bool_and(try_cast(conv_id::varchar as double) is not null), bool_and(try_cast(role as double) is not null), bool_and(try_cast(turn || '.5' as double) is not null)]) as numeric from conversations")
def a23(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("conv"), "role", F.concat(F.col("turn").cast("string"), F.lit(".5")).alias("digits"))
    return catalog.numeric_columns(c, ["conv", "role", "digits"])


@query("o01_sorted_names", "select p_partkey, row_number() over (order by p_name, p_partkey) as pos from part")
def o01(spark, sf):
    return ranked(table(spark, sf, "part").select("p_name", "p_partkey"), [F.col("p_name"), F.col("p_partkey")], "pos").select("p_partkey", "pos")


@query("o03_trigger_order", "select l_orderkey, list(l_returnflag order by case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end, l_linenumber, l_extendedprice) as flags from lineitem group by 1")
def o03(spark, sf):
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "l_linenumber", "l_extendedprice", "l_returnflag")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(ordered, lambda s: s["l_returnflag"]).alias("flags"))


@query("o05_nulls_last", "select s_nationkey, list(s_suppkey order by nullif(s_suppkey % 3, 0) nulls last, s_suppkey) as ids from supplier group by 1")
def o05(spark, sf):
    k = F.nullif(F.col("s_suppkey") % 3, F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct(k.isNull().alias("n"), k.alias("k"), "s_suppkey")))
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.transform(ordered, lambda s: s["s_suppkey"]).alias("ids"))


@query("o06_reference", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderkey) as k from orders) where k = 1")
def o06(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return catalog.first_by(table(spark, sf, "orders").select("o_custkey", rank.alias("rank"), "o_orderkey"), ["o_custkey"], ["rank", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("o07_largest", "select l_suppkey, max(l_extendedprice) as most, arg_max(l_orderkey, (l_extendedprice * 100)::bigint * 10000000 + l_orderkey) as l_orderkey from lineitem group by 1")
def o07(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("most"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("l_orderkey"))


@query("o09_errors_first", "select p_brand, list(p_partkey order by (p_size <= 45)::int, p_partkey) as ids from part group by 1")
def o09(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct((F.col("p_size") <= 45).alias("ok"), "p_partkey")))
    return table(spark, sf, "part").groupBy("p_brand").agg(F.transform(ordered, lambda s: s["p_partkey"]).alias("ids"))


@query("o11_paging", "select c_custkey, c_name from customer order by c_custkey limit 16 offset 32")
def o11(spark, sf):
    return table(spark, sf, "customer").orderBy("c_custkey").offset(32).limit(16).select("c_custkey", "c_name")


@query("u02_union_sources", "select s_suppkey as id, s_name as name, s_acctbal as z from supplier union all select n_nationkey, n_name, null from nation")
def u02(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("z"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "u03_ordered_union",
    "with u as (select p_brand as k, 0 as part, p_partkey as pos from part where p_size < 4 union all select p_brand, 1, p_partkey from part), f as (select k, min(part * 1000000000 + pos) as place from u group by 1) select k, row_number() over (order by place) as rank from f",
)
def u03(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("pos"), "p_size")
    out = catalog.ordered_union([p.where("p_size < 4"), p], "k", "pos")
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("u04_except", "select n_nationkey from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9900)")
def u04(spark, sf):
    return catalog.unknown(table(spark, sf, "nation"), table(spark, sf, "customer").where("c_acctbal > 9900"), "n_nationkey", "c_nationkey")


@query("u07_file_list", "select distinct p_type || '/' || p_brand as path from part")
def u07(spark, sf):
    return table(spark, sf, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("path")).distinct()


@query("k12_vector_index", 'select l_suppkey, n, (sum(n) over (order by l_suppkey))::bigint as "end" from (select l_suppkey, count(*) as n from lineitem group by 1)')
def k12(spark, sf):
    from spoolwave.operators.units import ragged_index

    return ragged_index(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), ["l_suppkey"], "n")


@query("k13_electrodes", "select s_suppkey, coalesce(case when s_acctbal >= 0 then s_acctbal end, 'nan'::double) as impedance from supplier")
def k13(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")), F.lit(float("nan"))).alias("impedance"))


@query("k15_models", "select p_brand, arg_min(p_name, p_partkey) as model from part group by 1")
def k15(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("model"))


@query("s02_detection", "select c_custkey, reader from (select c_custkey, reader, row_number() over (partition by c_custkey order by confidence desc, ord) as k from (select c_custkey, unnest(['a', 'b', 'c']) as reader, unnest([(floor(c_acctbal)::bigint % 5) / 4.0, (c_custkey % 5) / 4.0, 0.5]) as confidence, unnest([0, 1, 2]) as ord from customer where c_acctbal >= 0)) where k = 1")
def s02(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal >= 0")
    claims = F.array(*[F.struct(F.lit(r).alias("reader"), conf.cast("double").alias("confidence"), F.lit(i).alias("ord")) for i, (r, conf) in enumerate((("a", (F.floor("c_acctbal") % 5) / 4.0), ("b", (F.col("c_custkey") % 5) / 4.0), ("c", F.lit(0.5))))])
    rows = c.select("c_custkey", F.explode(claims).alias("m")).select("c_custkey", "m.reader", (-F.col("m.confidence")).alias("neg"), "m.ord")
    return catalog.first_by(rows, ["c_custkey"], ["neg", "ord"]).select("c_custkey", "reader")


@query("s19_hour_files", "select l_suppkey, l_linenumber, list(l_orderkey order by l_shipdate, l_orderkey, l_extendedprice) as files from lineitem where l_quantity > 45 group by 1, 2")
def s19(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_orderkey", "l_extendedprice")))
    return table(spark, sf, "lineitem").where("l_quantity > 45").groupBy("l_suppkey", "l_linenumber").agg(F.transform(ordered, lambda s: s["l_orderkey"]).alias("files"))


@query("s63_checked_bytes", "select sum(length(html))::bigint as bytes from pages where length(html) > 1000")
def s63(spark, sf):
    return table(spark, sf, "pages").where("length(html) > 1000").agg(F.sum(F.length("html").cast("bigint")).alias("bytes"))
