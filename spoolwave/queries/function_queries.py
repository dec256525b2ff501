"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoolwave.functions import numeric, text
from spoolwave.plans.tables import micros, table
from spoolwave.queries.registry import query

@query("n03_unpack", "select p_partkey, floor(w / 65536.0)::int as high, ((w & 65535) - case when (w & 65535) >= 32768 then 65536 else 0 end)::bigint as low from (select p_partkey, ((p_partkey * 2654435 + p_size * 77777) % 4294967296 - 2147483648)::bigint as w from part)")
def n03(spark, sf):
    w = F.pmod(F.col("p_partkey") * 2654435 + F.col("p_size") * 77777, F.lit(2**32)) - 2**31
    return table(spark, sf, "part").select("p_partkey", numeric.unpack_high(w.cast("int")).alias("high"), numeric.unpack_low(w).alias("low"))


@query("n04_offset_binary", "select l_orderkey, l_linenumber, l_extendedprice, (floor(l_extendedprice)::bigint % 65536 - 32768) as v from lineitem")
def n04(spark, sf):
    raw = F.floor("l_extendedprice") % 65536
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", numeric.offset_binary(raw).alias("v"))


@query("n05_stim", "select event_id, case when (v & 256) <> 0 then -(v & 255) else v & 255 end as stim from (select event_id, (event_id * 37) % 512 as v from events)")
def n05(spark, sf):
    return table(spark, sf, "events").select("event_id", numeric.stim_word((F.col("event_id") * 37) % 512).alias("stim"))


@query("n06_bits", "select o_orderkey, (o_orderkey >> 3) & 1 as b3, o_totalprice > 100000 as above from orders")
def n06(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numeric.bit(F.col("o_orderkey"), 3).alias("b3"), (F.col("o_totalprice") > 100000).alias("above"))


@query("n07_snap", "select event_id, round(round(value * 195312.5 * 1e9) / 1e9) / 195312.5 as t from events")
def n07(spark, sf):
    return table(spark, sf, "events").select("event_id", numeric.snapped(F.col("value")).alias("t"))


@query("n12_scale", "select p_partkey, (p_retailprice - 100) / nullif(p_size - 7, 0) as gain, 100 - 7 * ((p_retailprice - 100) / nullif(p_size - 7, 0)) as \"offset\" from part")
def n12(spark, sf):
    gain, offset = numeric.linear_scale(F.col("p_retailprice"), F.lit(100), F.col("p_size"), F.lit(7))
    return table(spark, sf, "part").select("p_partkey", gain.alias("gain"), offset.alias("offset"))


@query("n13_special_case", "select o_orderkey, case when o_orderkey = 21516 then 152592.547 else o_totalprice end as nv from orders")
def n13(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") == 21516, 152592.547).otherwise(F.col("o_totalprice")).alias("nv"))


@query("n14_inverted", "select c_custkey, c_acctbal * case when c_mktsegment = 'MACHINERY' then -1 else 1 end as gain from customer")
def n14(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numeric.inverted_gain(F.col("c_acctbal"), F.col("c_mktsegment") == "MACHINERY").alias("gain"))


@query("n15_units", "select p_partkey, case u when 'V' then 1.0 when 'mV' then 1e-3 when 'uV' then 1e-6 when 'nV' then 1e-9 end::double as factor from (select p_partkey, ['V', 'mV', 'uV', 'nV', 'x'][p_size % 5 + 1] as u from part)")
def n15(spark, sf):
    u = F.element_at(F.array(*map(F.lit, ("V", "mV", "uV", "nV", "x"))), F.col("p_size") % 5 + 1)
    return table(spark, sf, "part").select("p_partkey", numeric.unit_factor(u).alias("factor"))


@query("n16_impedance_unit", "select p_partkey, p_retailprice * case p_type when 'PROMO' then 1e3 when 'ECONOMY' then 1e6 else 1.0 end as ohms from part")
def n16(spark, sf):
    column = F.concat("p_name", F.when(F.col("p_type") == "PROMO", " (kOhm)").when(F.col("p_type") == "ECONOMY", " (MOhm)").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * numeric.impedance_factor(column)).alias("ohms"))


@query(
    "n17_ticks",
    """with r as (select o_orderkey, o_totalprice / 8 as raw, pow(10.0, floor(log10(o_totalprice / 8))) as m, o_totalprice as t from orders),
    s as (select o_orderkey, t, case when 10 * m <= raw then 10 * m when 5 * m <= raw then 5 * m when 2 * m <= raw then 2 * m else m end as step from r)
    select o_orderkey, step, ceil(100 / step)::bigint as first, floor((100 + t) / step)::bigint as last from s""",
)
def n17(spark, sf):
    step = numeric.nice_step(F.col("o_totalprice"), 8)
    first, last = numeric.tick_range(F.lit(100), F.col("o_totalprice") + 100, F.col("step"))
    return table(spark, sf, "orders").withColumn("step", step).select("o_orderkey", "step", first.alias("first"), last.alias("last"))


@query("n18_si", "select c_custkey, case when v = 0 then v when abs(v) >= 999.999 then v / 1e3 when abs(v) >= 0.999999 then v when abs(v) >= 0.999999e-3 then v / 1e-3 when abs(v) >= 0.999999e-6 then v / 1e-6 else v / 1e-9 end as scaled, case when v = 0 then '' when abs(v) >= 999.999 then 'k' when abs(v) >= 0.999999 then '' when abs(v) >= 0.999999e-3 then 'm' when abs(v) >= 0.999999e-6 then 'µ' else 'n' end as prefix from (select c_custkey, c_acctbal / pow(10, c_nationkey % 8) as v from customer)")
def n18(spark, sf):
    v = F.col("c_acctbal") / F.pow(F.lit(10), F.col("c_nationkey") % 8)
    scaled, prefix = numeric.si_scale(F.col("v"))
    return table(spark, sf, "customer").withColumn("v", v).select("c_custkey", scaled.alias("scaled"), prefix.alias("prefix"))


@query("n23_waveform_width", "select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey % 3 else floor((104 - 8) / 2) end::bigint as width from orders")
def n23(spark, sf):
    w = numeric.waveform_width(F.lit(104), F.lit(8), F.lit(2), F.col("o_orderkey") % 3)
    return table(spark, sf, "orders").select("o_orderkey", w.cast("bigint").alias("width"))


@query("n25_progress", "select o_orderkey, 100.0::double * o_orderkey / 1000000 as percent, case when o_orderkey > 0 then o_totalprice * (1000000 - o_orderkey) / o_orderkey end as remaining from orders")
def n25(spark, sf):
    percent, left = numeric.progress(F.col("o_orderkey"), F.lit(1000000), F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", percent.alias("percent"), left.alias("remaining"))


@query("t01_safe_name", r"select page_id, case when b = '' then 'unnamed' else b end as name from (select page_id, regexp_replace(regexp_replace(url, '[/\\]+$', ''), '[/\\]', '_', 'g') as b from pages)")
def t01(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("t02_store_file", r"""select p_partkey, p_type as store, p_size as channel, case when p_partkey % 2 = 0 then p_partkey::int else 0 end as hour from part""")
def t02(spark, sf):
    hour = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), F.col("p_partkey").cast("string"), F.lit("h"))).otherwise("")
    name = F.concat(F.lit("block-1_"), "p_type", F.lit("_Ch"), F.col("p_size").cast("string"), hour, F.lit(".sev"))
    store, channel, h = text.store_file(name)
    return table(spark, sf, "part").select("p_partkey", store.alias("store"), channel.alias("channel"), h.alias("hour"))


@query("t05_subset", "select p_partkey, list_concat(range(p_size, p_size + 4), [100 + p_size])::int[] as channels from part")
def t05(spark, sf):
    size = F.col("p_size")
    s = F.concat(size.cast("string"), F.lit(":"), (size + 3).cast("string"), F.lit(","), (size + 100).cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.subset(s).alias("channels"))


@query("t06_entries", "select p_partkey, [p_name, p_brand] as items from part")
def t06(spark, sf):
    s = F.concat(F.lit("(head,2)("), "p_name", F.lit(")("), "p_brand", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", text.entries(s).alias("items"))


@query("t07_counts", "select p_partkey, [p_size, null, 7]::int[] as n from part")
def t07(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.counts(F.concat(F.col("p_size").cast("string"), F.lit(",x, 7"))).alias("n"))


@query("t08_model", "select p_partkey, p_brand as model from part")
def t08(spark, sf):
    s = F.concat("p_brand", F.when(F.col("p_size") > 20, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", text.model(s).alias("model"))


@query("t09_bank", "select p_partkey, case when p_size between 1 and 26 then chr(64 + p_size) end as bank from part")
def t09(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.bank(F.col("p_size")).alias("bank"))


@query("t10_note_label", "select conv_id, turn, concat_ws(': ', nullif(case when turn % 2 = 0 then role else '' end, ''), nullif(left(text, 12), '')) as label from conversations")
def t10(spark, sf):
    button = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.note_label(button, F.substring("text", 1, 12)).alias("label"))


@query("t11_single_byte", "select c_custkey, c_name as name from customer")
def t11(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.decode(F.encode("c_name", "ISO-8859-1"), "ISO-8859-1").alias("name"))


@query("t13_store_name", "select p_partkey, left(p_type, 4) as name from part")
def t13(spark, sf):
    s = F.concat(F.substring("p_type", 1, 4), F.lit("\u0000junk"))
    return table(spark, sf, "part").select("p_partkey", text.up_to_nul(s).alias("name"))


@query("t14_iso", "select event_id, case when epoch_us(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as iso from events")
def t14(spark, sf):
    return table(spark, sf, "events").select("event_id", text.iso_from_micros(micros("ts")).alias("iso"))


@query("t15_parse_iso", "select event_id, epoch_us(ts) as us from events")
def t15(spark, sf):
    zone = F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z")
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return table(spark, sf, "events").select("event_id", text.micros_from_iso(iso).alias("us"))


@query("t16_zone", "select event_id, event_id % 3 > 0 as zoned from events")
def t16(spark, sf):
    s = F.concat(F.lit("2024-01-01T00:00:00"), F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("-05:00")), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", text.has_zone(s).alias("zoned"))


@query("t17_start_time", "select c_custkey, case when c_nationkey % 3 = 0 then '2024-05-01T10:00:00Z' when c_nationkey % 3 = 1 then '2024-05-01T10:00:00+01:00' else '2020-01-01T00:00:00+01:00' end as start from customer")
def t17(spark, sf):
    k = F.col("c_nationkey") % 3
    stated = F.when(k == 0, "2024-05-01T10:00:00Z").when(k == 1, "2024-05-01T10:00:00")
    return table(spark, sf, "customer").select("c_custkey", text.start_time(stated, F.lit("+01:00"), F.lit("2020-01-01T00:00:00")).alias("start"))


@query("t18_clock", "select event_id, (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + extract(second from ts))::int as seconds from events")
def t18(spark, sf):
    ts = F.col("ts").cast("timestamp")
    s = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "h:mm:ssa")).otherwise(F.date_format(ts, "H:mm:ss"))
    return table(spark, sf, "events").select("event_id", text.clock_seconds(s).alias("seconds"))


@query("t19_stamp", "select o_orderkey, o_orderdate + case when year(o_orderdate) < 2000 then interval 100 year else interval 0 year end as start from orders")
def t19(spark, sf):
    name = F.concat(F.lit("rec_"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyMMdd_HHmmss"))
    return table(spark, sf, "orders").select("o_orderkey", text.stamp_in_name(name).cast("timestamp_ntz").alias("start"))


@query("t20_settings_date", "select o_orderkey, o_orderdate as date from orders")
def t20(spark, sf):
    said = F.date_format(F.col("o_orderdate").cast("timestamp"), "d MMM yyyy HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", F.to_timestamp(said, "d MMM yyyy HH:mm:ss").cast("timestamp_ntz").alias("date"))


@query("t21_two_dates", "select o_orderkey, o_orderdate as date from orders")
def t21(spark, sf):
    ts = F.col("o_orderdate").cast("timestamp")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(ts, "M/d/yyyy")).otherwise(F.date_format(ts, "yyyy/M/d"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_to_timestamp(said, F.lit("M/d/yyyy")), F.try_to_timestamp(said, F.lit("yyyy/M/d"))).cast("timestamp_ntz").alias("date"))


@query("t22_origin", "select o_orderkey, case when year(o_orderdate) >= 1995 then o_orderdate end as origin from orders")
def t22(spark, sf):
    d = F.col("o_orderdate")
    made = F.make_timestamp(F.year(d), F.month(d), F.day(d), F.lit(0), F.lit(0), F.lit(0))
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.year(d) >= 1995, made.cast("timestamp_ntz")).alias("origin"))


@query("t24_age", "select c_custkey, c_nationkey + 1 as n, ['D', 'W', 'M', 'Y'][c_nationkey % 4 + 1] as unit from customer")
def t24(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, "DWMY")), F.col("c_nationkey") % 4 + 1)
    n, u = text.age(F.concat(F.lit("P"), (F.col("c_nationkey") + 1).cast("string"), unit))
    return table(spark, sf, "customer").select("c_custkey", n.alias("n"), u.alias("unit"))


@query("t25_slices", "select vec_id, list_sum(embedding[9:12]::double[]) as total from embeddings")
def t25(spark, sf):
    v = text.event_values(F.col("embedding"), F.lit(2), 4)
    return table(spark, sf, "embeddings").select("vec_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("t27_extras", "select p_brand, list_sort(list(distinct p_type)) as types from part group by 1")
def t27(spark, sf):
    m = table(spark, sf, "part").select("p_brand", F.create_map(F.lit("type"), F.col("p_type")).alias("extra"))
    return m.groupBy("p_brand").agg(F.array_sort(F.collect_set(F.col("extra")["type"])).alias("types"))


@query("t28_pruned", "select c_custkey, case when c_acctbal < 0 then '{\"name\":\"' || c_name || '\"}' else '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' end as said from customer")
def t28(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))).alias("said"))


@query("t29_hex", "select o_orderkey, lpad(lower(to_hex(o_orderkey * 7919)), 16, '0') as hex from orders")
def t29(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.hex16(F.col("o_orderkey") * 7919).alias("hex"))


@query("t30_container", "select page_id, list_last(string_split(url, '/')) as name from pages")
def t30(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.last_part(F.col("url")).alias("name"))


@query("t31_numbers", "select l_orderkey, l_linenumber, l_extendedprice, l_quantity::bigint::varchar as said from lineitem")
def t31(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", text.number_text(F.col("l_quantity")).alias("said"))


@query("t32_per_channel", "select p_partkey, case when p_size > 25 then [p_brand, p_brand, p_brand] else [p_brand, p_type, p_name] end as words from part")
def t32(spark, sf):
    w = F.when(F.col("p_size") > 25, F.array("p_brand")).otherwise(F.array("p_brand", "p_type", "p_name"))
    return table(spark, sf, "part").select("p_partkey", text.per_channel(w, 3).alias("words"))


@query("t33_application", "select c_custkey, coalesce(case when c_acctbal > 5000 then c_name || ' v2' end, c_mktsegment) as app from customer")
def t33(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 5000, F.concat("c_name", F.lit(" v2"))), "c_mktsegment").alias("app"))


@query("k05_output_format", "select p_partkey, case when p_size > 25 then 'hdf5' else 'zarr' end as format, p_name || '.nwb.zarr' as renamed from part")
def k05(spark, sf):
    path = F.concat("p_name", F.when(F.col("p_size") > 25, ".NWB").otherwise(".nwb.zarr"))
    return table(spark, sf, "part").select("p_partkey", text.output_format(path).alias("format"), text.output_name(path, ".nwb.zarr").alias("renamed"))
