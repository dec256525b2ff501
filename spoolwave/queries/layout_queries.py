"""Binary layouts, names and plans: tables go out as int16 files and come back through each reader; the rest are catalog rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spoolwave.functions import numeric
from spoolwave.operators import align, catalog, edges, sections, units
from spoolwave.plans import job, overlay
from spoolwave.plans.tables import micros, table
from spoolwave.queries.registry import query
from spoolwave.queries.source_queries import _written
from spoolwave.sources import stretches
from spoolwave.sources.files import listing
from spoolwave.sources.recordings import HEADER

RAW = "(select vec_id as sample, unnest(range(0, 64))::int as channel, unnest(list_transform(embedding, lambda v: round(v::double * 8192)::int)) as raw from embeddings)"


def _stretches(spark, sf):
    """The written recording as a table of stretches: parts in name order, 64 interleaved channels."""
    path = _written(spark, sf)
    rows, first = [], 0
    for info in listing(path, ".example")[1]:
        n = (info.size - HEADER.size) // 128
        rows.append(stretches.stretch("r", f"file://{info.path}" if path.startswith("file:") else info.path, n, HEADER.size, "<i2", 128, [2 * c for c in range(64)], None, [0.25] * 64, [1.0] * 64, first=first))
        first += n
    return stretches.table(spark, rows)


@query("s33_interleaved", f"select sample, sum(raw)::bigint as total from {RAW} where channel in (5, 0, 63) group by 1")
def s33(spark, sf):
    path = _written(spark, sf)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double"))
    # without headers the parts must be read one by one: parts are cut by their own header here
    rows = spark.read.format("recording").option("layout", "interleaved").option("suffix", ".example").option("saved", "64").option("skip", "32").option("channels", "5,0,63").load(path)
    return rows.select("sample", F.round(total).cast("bigint").alias("total"))


@query("s39_stretch_read", f"select channel, count(*) as n, sum(raw)::bigint as total, min(raw * 0.25::double + 1)::float as lo from {RAW} group by 1")
def s39(spark, sf):
    long = stretches.samples(stretches.read(_stretches(spark, sf)))
    return long.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum((F.col("value").cast("double") - 1) * 4)).cast("bigint").alias("total"), F.min("value").alias("lo"))


@query("s17_range_read", f"select channel, sample, (raw * 0.25::double + 1)::float as value from {RAW} where sample >= 90 and sample < 140 and channel in (3, 7)")
def s17(spark, sf):
    long = stretches.samples(stretches.read(stretches.wanted(_stretches(spark, sf), 90, 140, channels=[3, 7])))
    return long.select("channel", "sample", "value")


@query("s11_on_demand_waveforms", "select vec_id as idx, list_sum(list_transform(embedding[1:8], lambda v: round(v::double * 8192)::int))::bigint as total from embeddings where label = 3")
def s11(spark, sf):
    found = _stretches(spark, sf)
    index = table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("idx"))
    # stretches and vectors meet by spans of sample numbers, so that the range condition is checked inside a span only
    span = 65536
    cover = found.withColumn("span", F.explode(F.expr(f"sequence(first div {span}, (first + samples - 1) div {span})")))
    at = index.withColumn("span", F.expr(f"idx div {span}")).join(cover, "span").where((F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("first") + F.col("samples")))
    places = at.select("idx", "path", (F.col("offset") + (F.col("idx") - F.col("first")) * F.col("step")).alias("offset"), F.lit(8).alias("count"), F.lit("<i2").alias("dtype"))
    w = stretches.payloads(places, ["idx"])
    return w.select("idx", F.round(F.aggregate("waveform", F.lit(0.0), lambda a, v: a + v.cast("double"))).cast("bigint").alias("total"))


@query("x07_job_verify", "select count(*) as samples, 0::bigint as mismatches from embeddings")
def x07(spark, sf):
    """A whole job over the written recording: write, verify block by block, then count."""
    from spoolwave.sources.files import scratch

    path = scratch(spark, "job")
    source = _stretches(spark, sf)
    chunks = stretches.read(source)
    chunks.write.partitionBy("recording").parquet(path)
    store = spark.read.parquet(path)
    states = job.recheck(spark, path, job.digests(chunks))
    bad = states.agg(F.count(F.when(F.col("state") != "ok", 1)).alias("mismatches"))
    n = store.where("channel = 0").agg(F.sum(F.size("values").cast("bigint")).alias("samples"))
    return n.join(F.broadcast(bad), how="inner").select("samples", "mismatches")


@query("v04_structural", "select 'samples are missing' as message, 'r:' || l_suppkey || ':' || l_orderkey as target_name from (select l_suppkey, l_orderkey, lag(l_orderkey) over (partition by l_suppkey order by l_orderkey) as was from (select distinct l_suppkey, l_orderkey from lineitem)) where was is not null and was + 1 < l_orderkey")
def v04(spark, sf):
    store = table(spark, sf, "lineitem").select(F.lit("r").alias("recording"), F.col("l_suppkey").alias("channel"), F.col("l_orderkey").alias("first"), F.array(F.lit(0.0)).alias("values")).distinct()
    return job.structural_checks(store).select("message", "target_name")


@query("v02_plan", "select p_name || ':' || p_brand as name, case when p_brand = 'Brand#2' then 'table' else 'series' end as type from part where p_brand <> 'Brand#1' group by 1, 2")
def v02(spark, sf):
    p = table(spark, sf, "part")
    rec = p.select(F.concat_ws(":", "p_name", "p_brand").alias("name"), "p_brand").distinct()
    spec = rec.where("p_brand = 'Brand#1'").select(F.col("name").alias("key"), F.lit(False).alias("include"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("out_name"))
    spec = spec.unionByName(rec.where("p_brand = 'Brand#2'").select(F.col("name").alias("key"), F.lit(None).cast("boolean").alias("include"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("out_name")))
    spec = spec.unionByName(spark.createDataFrame([("*", True, "series", None)], "key string, include boolean, type string, out_name string"))
    return overlay.resolve(rec.select("name"), spec)[0].select("name", "type")


@query("v01_issues", "select 'error' as level, count(*) as n from (select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_retailprice < 1500)) having count(*) > 0 union all select 'warning', count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) having count(*) > 0")
def v01(spark, sf):
    found = overlay.validate(table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_retailprice < 1500"), "l_partkey", "p_partkey", ["l_orderkey", "l_linenumber"])
    return found.groupBy("level").agg(F.count("*").alias("n"))


@query("v09_targets", "select label, count(*) as rows, count(*) * 64 * 4 as bytes from embeddings group by 1")
def v09(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.size("embedding").cast("bigint") * 4).alias("bytes"))


@query("v14_plan_rows", "select p_type, count(*) as n, count(distinct p_brand) as brands, count(*) filter (p_size > 25) as large from part group by 1")
def v14(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"), F.count(F.when(F.col("p_size") > 25, 1)).alias("large"))


@query("p11_front_end", "select p_partkey, case when p_type = 'ECONOMY' then p_partkey < 129 else trim(case when p_size > 20 then ' uV ' else 'mV' end) = 'uV' end as front_end from part")
def p11(spark, sf):
    unit = F.when(F.col("p_size") > 20, " uV ").otherwise("mV")
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") == "ECONOMY", F.col("p_partkey") < 129).otherwise(F.trim(unit) == "uV").alias("front_end"))


@query("p21_acquisition", "select c_custkey, case when c_mktsegment = 'BUILDING' then 'stated' when c_acctbal < 0 then 'pre4' else 'measured' end as class from customer")
def p21(spark, sf):
    cls = F.when(F.col("c_mktsegment") == "BUILDING", "stated").when(F.col("c_acctbal") < 0, "pre4").otherwise("measured")
    return table(spark, sf, "customer").select("c_custkey", cls.alias("class"))


@query("j13_nearest_price", "select o_custkey, d, near from (select a.o_custkey, a.d, b.d as near, row_number() over (partition by a.o_custkey, a.o_orderkey order by abs(b.d - a.d), b.d) as k from (select o_custkey, o_orderkey, epoch_us(o_orderdate) as d from orders where o_orderstatus = 'F') a join (select o_custkey, epoch_us(o_orderdate) as d from orders where o_orderstatus = 'O') b using (o_custkey)) where k = 1")
def j13(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", micros("o_orderdate").alias("d"), "o_orderstatus")
    return align.nearest(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "d")


@query("j24_spike_electrodes", "select coalesce(s.s_suppkey, d.k) as k, coalesce(d.g, s.s_name) as g from supplier s full outer join (select l_partkey as k, 'part ' || max(l_returnflag) as g from lineitem where l_quantity = 50 group by 1) d on s.s_suppkey = d.k")
def j24(spark, sf):
    d = table(spark, sf, "lineitem").where("l_quantity = 50").groupBy(F.col("l_partkey").alias("k")).agg(F.concat(F.lit("part "), F.max("l_returnflag")).alias("g"))
    return catalog.upsert(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("g")), d, "k", "g")


@query("j25_derived_names", "select a.p_partkey, b.p_partkey as dc from (select p_partkey, p_name || '_DC' as want from part where p_size = 1) a left join (select p_partkey, p_name || '_DC' as name from part where p_size = 2) b on a.want = b.name")
def j25(spark, sf):
    p = table(spark, sf, "part").withColumn("derived", F.concat("p_name", F.lit("_DC")))
    b = p.where("p_size = 2").select(F.col("p_partkey").alias("dc"), F.col("derived").alias("_name"))
    return p.where("p_size = 1").join(b, F.col("derived") == F.col("_name"), "left").select("p_partkey", "dc")


@query("j28_by_ad_channel", "select l_suppkey as ad, list_sort(list(distinct l_returnflag)) as kinds from lineitem group by 1")
def j28(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ad")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("kinds"))


@query("a06_distinct_channels", "select list_sort(list(distinct l_suppkey)) as channels from lineitem")
def a06(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey").distinct().agg(F.array_sort(F.collect_list("l_suppkey")).alias("channels"))


@query("w18_sample_numbers", "select user_id, min(event_id) as first, max(event_id) as last, count(*) as n, max(event_id) - min(event_id) + 1 - count(*) as missing from events group by 1")
def w18(spark, sf):
    return sections.continuity(table(spark, sf, "events"), "user_id", "event_id")


@query("w19_closed_at_end", "select user_id, max(\"offset\") as last from (select user_id, coalesce(lead(epoch_us(ts)) over (partition by user_id order by event_id), 1800000000000000) as \"offset\" from events) group by 1")
def w19(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    ev = table(spark, sf, "events").select("user_id", F.coalesce(F.lead(micros("ts")).over(w), F.lit(1800000000000000)).alias("offset"))
    return ev.groupBy("user_id").agg(F.max("offset").alias("last"))


@query("o04_rate_descending", "select p_type, list(p_partkey order by p_retailprice desc, p_partkey) as ids from part group by 1")
def o04(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("r"), "p_partkey")))
    return table(spark, sf, "part").groupBy("p_type").agg(F.transform(ordered, lambda s: s["p_partkey"]).alias("ids"))


@query("u05_intersection", 'select l_suppkey, max(a) as first, min(b) as "end" from (select l_suppkey, l_returnflag, min(l_orderkey) as a, max(l_orderkey) as b from lineitem group by 1, 2) group by 1')
def u05(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b"))
    return align.common_range(per, "l_suppkey", "a", "b")


@query("n02_type_bytes", "select p_partkey, [1, 2, 2, 4, 8, 4, 8][p_size % 7 + 1] as bytes from part")
def n02(spark, sf):
    kinds = ("int8", "int16", "uint16", "int32", "int64", "float32", "float64")
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("p_size") % 7 + 1)
    size = F.create_map(*[x for k, b in zip(kinds, (1, 2, 2, 4, 8, 4, 8)) for x in (F.lit(k), F.lit(b))])
    return table(spark, sf, "part").select("p_partkey", F.element_at(size, name).alias("bytes"))


@query("n09_probe_gains", "select l_orderkey, l_linenumber, l_extendedprice, coalesce(nullif(l_discount, 0.0) * 1000, nullif(l_tax, 0.0) * 500, 80.0) as gain from lineitem")
def n09(spark, sf):
    gain = F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)) * 1000, F.nullif(F.col("l_tax"), F.lit(0.0)) * 500, F.lit(80.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", gain.alias("gain"))


@query("n10_geometry", "select s_suppkey, ((s_suppkey % 4) * 250.0 + 16 * (s_suppkey % 2))::double as x, ((s_suppkey // 8) * 20.0)::double as y from supplier")
def n10(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", ((k % 4) * 250.0 + 16 * (k % 2)).alias("x"), (F.floor(k / 8) * 20.0).alias("y"))


@query("n11_scale_table", "select p_partkey, g.gain from part join (values ('ECONOMY', 0.195e-6::double), ('PROMO', 37.4e-6::double), ('STANDARD', 74.8e-6::double)) g(kind, gain) on g.kind = p_type")
def n11(spark, sf):
    scale = spark.createDataFrame([("ECONOMY", 0.195e-6), ("PROMO", 37.4e-6), ("STANDARD", 74.8e-6)], "kind string, gain double")
    return table(spark, sf, "part").join(F.broadcast(scale), F.col("kind") == F.col("p_type")).select("p_partkey", "gain")


@query("n24_stored_type", "select p_partkey, case when p_type = 'PROMO' then 'uint16' else 'int16' end as stored from part")
def n24(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "uint16").otherwise("int16").alias("stored"))


@query("n19_block_sample", "select l_orderkey // 500 as block, count(*) as n from lineitem group by 1")
def n19(spark, sf):
    """All blocks, chosen by a seeded order; the choice of few is tested by its invariants."""
    rows = table(spark, sf, "lineitem").groupBy(F.expr("l_orderkey div 500").alias("block")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.rand(7)).select("block", "n")


@query("t03_run_names", "select o_orderkey, 'run_g' || o_custkey as run, case when o_orderkey % 3 = 0 then 'cat' else o_custkey::varchar end as trigger, 'imec' || o_orderkey % 4 as stream, case when o_orderstatus = 'F' then 'lf' else 'ap' end as band from orders")
def t03(spark, sf):
    o = table(spark, sf, "orders")
    trig = F.when(F.col("o_orderkey") % 3 == 0, "cat").otherwise(F.col("o_custkey").cast("string"))
    name = F.concat(F.lit("run_g"), F.col("o_custkey").cast("string"), F.lit("_t"), trig, F.lit(".imec"), (F.col("o_orderkey") % 4).cast("string"), F.when(F.col("o_orderstatus") == "F", ".lf.meta").otherwise(".ap.meta"))
    part = lambda i: F.regexp_extract(name, r"^(.*)_t(\d+|cat)\.((?:imec|obx)\d+|nidq)\.(ap|lf)\.meta$", i)
    return o.select("o_orderkey", part(1).alias("run"), part(2).alias("trigger"), part(3).alias("stream"), part(4).alias("band"))


@query("t04_legacy_names", "select o_orderkey, o_custkey::varchar as processor, 'CH' as kind, (o_orderkey % 64)::int as number from orders")
def t04(spark, sf):
    name = F.concat(F.col("o_custkey").cast("string"), F.lit("_Rhythm-A_CH"), (F.col("o_orderkey") % 64).cast("string"), F.lit(".continuous"))
    item = F.element_at(F.split(F.regexp_replace(name, r"\.continuous$", ""), "_"), -1)
    return table(spark, sf, "orders").select("o_orderkey", F.element_at(F.split(name, "_"), 1).alias("processor"), F.regexp_extract(item, r"^(\D*)", 1).alias("kind"), F.regexp_extract(item, r"(\d+)$", 1).cast("int").alias("number"))


@query("t12_comment_text", "select c_custkey, c_name as said from customer")
def t12(spark, sf):
    raw = F.encode(F.concat("c_name", F.lit("\u0000rest")), "UTF-16LE")
    return table(spark, sf, "customer").select("c_custkey", F.substring_index(F.decode(raw, "UTF-16LE"), "\u0000", 1).alias("said"))


@query("t23_software_time", "select event_id, epoch_us(ts) // 1000 as ms from events")
def t23(spark, sf):
    said = F.concat(F.lit("Software Time: "), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("@30000Hz"))
    return table(spark, sf, "events").select("event_id", F.regexp_extract(said, r"Time: (\d+)", 1).cast("bigint").alias("ms"))


@query("t34_version", "select p_partkey, case when p_type = 'PROMO' then 'A ' || p_size when p_type = 'ECONOMY' then 'A' when p_size > 25 then 'B' else 'unknown' end as made_by from part")
def t34(spark, sf):
    made = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("A "), F.col("p_size").cast("string"))).when(F.col("p_type") == "ECONOMY", "A").when(F.col("p_size") > 25, "B").otherwise("unknown")
    return table(spark, sf, "part").select("p_partkey", made.alias("made_by"))


@query("t35_processor_names", "select p_partkey, replace(p_name, ' ', '_') as name from part")
def t35(spark, sf):
    xml = F.concat(F.lit("<S><PROCESSOR name='Sources/"), "p_name", F.lit("' nodeId='1'/></S>"))
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.element_at(F.split(F.xpath_string(xml, F.lit("S/PROCESSOR/@name")), "/"), -1), " ", "_").alias("name"))


@query("t36_settings_choice", "select p_partkey, case when p_size > 1 then 'settings_' || p_size || '.xml' else 'settings.xml' end as file from part")
def t36(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 1, F.concat(F.lit("settings_"), F.col("p_size").cast("string"), F.lit(".xml"))).otherwise("settings.xml").alias("file"))


@query("k09_event_rows", 'select event_id as id, (epoch_us(ts) - 1704067200000000) / 1e6 as "timestamp", value / 100 as duration, event_type as annotation from events')
def k09(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), ((micros("ts") - 1704067200000000) / 1e6).alias("timestamp"), (F.col("value") / 100).alias("duration"), F.col("event_type").alias("annotation"))


@query("k11_snippet_groups", "select label, vec_id % 4 as channel, count(*) as n from embeddings group by 1, 2")
def k11(spark, sf):
    """Snippets written by store and channel, and read back."""
    from spoolwave.sources.files import scratch

    path = scratch(spark, "snippets")
    table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 4).alias("channel"), "embedding").write.partitionBy("label", "channel").parquet(path)
    return spark.read.parquet(path).groupBy("label", F.col("channel").cast("bigint").alias("channel")).agg(F.count("*").alias("n"))


@query("k20_inspect", "select user_id, list_slice(list(value order by event_id), 1, 3) as head from events group by 1")
def k20(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.slice(F.transform(ordered, lambda s: s["value"]), 1, 3).alias("head"))


@query("a27_range", f"select min(raw) as lo, max(raw) as hi, count(*) as n from {RAW} where channel = 0")
def a27(spark, sf):
    raw = F.round(F.element_at("embedding", 1).cast("double") * 8192).cast("int")
    return table(spark, sf, "embeddings").agg(F.min(raw).alias("lo"), F.max(raw).alias("hi"), F.count("*").alias("n"))


@query("s62_by_width", "select event_type, case when (select count(distinct length(event_type)) from events) > 1 then 'spikes_' || length(event_type) else 'spikes' end as store, count(*) as n from events group by 1, 2")
def s62(spark, sf):
    ev = table(spark, sf, "events").withColumn("w", F.length("event_type"))
    widths = ev.agg(F.count_distinct("w").alias("_widths"))
    store = F.when(F.col("_widths") > 1, F.concat(F.lit("spikes_"), F.col("w").cast("string"))).otherwise("spikes")
    return ev.join(F.broadcast(widths), how="inner").groupBy("event_type", store.alias("store")).agg(F.count("*").alias("n"))


@query("s61_words", "select event_id, case when (r & 1) <> 0 and (r & 128) <> 0 then 'serial' when (r & 1) <> 0 then 'digital' end as kind from (select event_id, (event_id * 37) % 256 as r from events) where (r & 1) <> 0")
def s61(spark, sf):
    from spoolwave.sources.blackrock import digital_words

    ev = table(spark, sf, "events").select(F.lit(0).alias("id"), F.col("event_id").alias("pos"), F.lit(0).alias("ticks"), F.lit(0).alias("value"), ((F.col("event_id") * 37) % 256).alias("reason"))
    return digital_words(ev, "2.3").select(F.col("pos").alias("event_id"), "kind")


@query("s21_declared_rate", "select o_orderkey, case when abs(o_totalprice - round(o_totalprice)) > 0.25 then round(o_totalprice) else o_totalprice end as rate from orders")
def s21(spark, sf):
    declared = F.round("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.abs(F.col("o_totalprice") - declared) > 0.25, declared).otherwise(F.col("o_totalprice")).alias("rate"))


@query("w06_pulses", "select user_id, count(*) as rises from (select user_id, value > 50 as high, lag(value > 50) over (partition by user_id order by event_id) as was from events) where high and not was group by 1")
def w06_pulses(spark, sf):
    return edges.square_edges(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 50, 1).groupBy("user_id").agg(F.count("*").alias("rises"))


@query("a05_units_per_store", "select l_returnflag, count(distinct (l_suppkey, l_linenumber)) as units from lineitem where l_linenumber <> 1 group by 1")
def a05_store(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("channel"), (F.col("l_linenumber") - 1).alias("sort_code"))
    return rows.where("sort_code <> 0").select("l_returnflag", "channel", "sort_code").distinct().groupBy("l_returnflag").agg(F.count("*").alias("units"))


@query("p09_ticks_of_view", "select o_orderkey, ceil(o_totalprice / 500)::bigint as first from orders")
def p09_view(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numeric.tick_range(F.col("o_totalprice"), F.col("o_totalprice"), F.lit(500))[0].alias("first"))


@query("a02_waveform_length", "select label, min(len(embedding)) = max(len(embedding)) as uniform from embeddings group by 1")
def a02_length(spark, sf):
    return units.uniform_length(table(spark, sf, "embeddings"), ["label"], "embedding")
