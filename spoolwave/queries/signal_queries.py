"""Signals and snippets: `embeddings` is a recording of 64 channels (sample = vec_id) and a snippet store (sort code = label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolwave.functions import numeric
from spoolwave.operators import integrity, sections, signal, units
from spoolwave.plans.tables import micros, table
from spoolwave.queries.registry import query

LONG = "(select vec_id as sample, unnest(range(0, len(embedding)))::int as channel, unnest(embedding)::double as value from embeddings)"
N = "(select max(vec_id) + 1 from embeddings)"
ENVELOPE = f"(select channel, (sample * 33) // {N} as col, min(value) as lo, max(value) as hi from {LONG} where not isnan(value) group by 1, 2)"


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("embedding").alias("values"), "label")


def _envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The whole recording in 33 columns."""
    return signal.envelope(_signal(spark, sf), 0, _end(spark, sf), 33)


def _end(spark: SparkSession, sf: str) -> int:
    return (table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


@query("a01_envelope", f'select channel, col as "column", lo, hi from {ENVELOPE}')
def a01(spark, sf):
    return _envelope(spark, sf)


@query("a01_envelope_short", f'select channel, sample - 7 as "column", value as lo, value as hi from {LONG} where sample >= 7 and sample < 12')
def a01_short(spark, sf):
    return signal.envelope(_signal(spark, sf), 7, 12, 100)


@query(
    "a15_resample",
    f"""with v as (select range as view, ((3.0 + range * 10.0 / 20) * 25) as s0, {N}::double as n from range(20)),
    b as (select view, n, greatest(floor(s0 / n * 33), 0)::int as c0, s0, s0 + 10.0 / 20 * 25 as s1 from v),
    c as (select view, c0, least(greatest(least(ceil(s1 / n * 33), 33)::int, c0 + 1), 33) as c1 from b where s1 > 0 and s0 < n)
    select e.channel, c.view as "column", min(lo) as lo, max(hi) as hi from {ENVELOPE} e join c on e.col >= c.c0 and e.col < c.c1 group by 1, 2""",
)
def a15(spark, sf):
    return signal.resample(_envelope(spark, sf), 33, 0, _end(spark, sf), 25.0, 3.0, 10.0, 20)


@query("a14_peak", f"select coalesce(max(greatest(abs(lo), abs(hi))), 0) as peak from {ENVELOPE} where isfinite(lo) and isfinite(hi)")
def a14(spark, sf):
    return signal.peak(_envelope(spark, sf))


@query("p01_channels", "select vec_id as sample, embedding[8]::double as c7, embedding[1]::double as c0, embedding[64]::double as c63 from embeddings")
def p01(spark, sf):
    v = signal.channels(_signal(spark, sf), [7, 0, 63])
    return v.select("sample", *[F.element_at("values", i + 1).cast("double").alias(f"c{c}") for i, c in enumerate((7, 0, 63))])


@query("p02_sample_range", "select vec_id as sample, label from embeddings where vec_id >= 120 and vec_id < 260")
def p02(spark, sf):
    return _signal(spark, sf).where("sample >= 120 and sample < 260").select("sample", "label")


@query("p07_calibrate", "select l_orderkey, l_linenumber, l_extendedprice, (l_quantity::int::double * (l_discount + 0.5) + l_tax)::float as value from lineitem")
def p07(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_extendedprice", signal.calibrated(F.col("l_quantity").cast("int"), F.col("l_discount") + 0.5, F.col("l_tax")).alias("value"))


@query(
    "p08_storage_choice",
    """with g as (select l_orderkey, min(l_discount) as lo, max(l_discount) as hi, max((l_tax > 0.06)::int) as off, bool_or(l_linestatus = 'O') as el from lineitem group by 1)
    select l_orderkey, case when off = 1 then 'float32' when lo = hi then 'int16_folded' when el then 'int16_per_channel' else 'float32' end as storage,
    case when off = 0 and lo = hi then lo end as gain from g""",
)
def p08(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("off", F.when(F.col("l_tax") > 0.06, 1).otherwise(0))
    return signal.storage_choice(line, "l_orderkey", "l_discount", "off", F.col("l_linestatus") == "O", F.lit("int16"))


@query("p09_window", "select o_orderkey, least(floor(greatest(o_totalprice / 1000 - 50, 0) * 25.0), 5000)::bigint as first, least(least(floor(greatest(o_totalprice / 1000 - 50, 0) * 25.0), 5000) + floor(greatest(o_totalprice / 100000 * 25.0, 1)), 5000)::bigint as \"end\" from orders")
def p09(spark, sf):
    o = table(spark, sf, "orders")
    first, end = signal.sample_range(F.lit(25.0), F.col("o_totalprice") / 1000 - 50, F.col("o_totalprice") / 100000, F.lit(5000).cast("bigint"))
    return o.select("o_orderkey", first.alias("first"), end.alias("end"))


@query("p14_nan_skip", f"select channel, max(value) as hi, count(*) as n from {LONG} where not isnan(value) group by channel")
def p14(spark, sf):
    return signal.long_form(_signal(spark, sf)).where(~F.isnan("value")).groupBy("channel").agg(F.max("value").alias("hi"), F.count("*").alias("n"))


@query("n21_fetch_range", "select o_orderkey, greatest((floor((o_totalprice / 10) / 500.0) - 1) * 500.0, 0) as start, 1500.0::double as span from orders")
def n21(spark, sf):
    start, span = signal.fetch_range(F.col("o_totalprice") / 10, F.lit(500.0))
    return table(spark, sf, "orders").select("o_orderkey", start.alias("start"), span.alias("span"))


@query(
    "a17_shortest",
    """with r as (select l_suppkey, l_returnflag, l_orderkey, row_number() over (partition by l_suppkey, l_returnflag order by l_orderkey, l_linenumber, l_extendedprice, l_quantity)::int - 1 as k from lineitem),
    m as (select l_suppkey, min(n) as n from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2) group by 1)
    select r.l_suppkey, r.l_returnflag, r.k, r.l_orderkey from r join m using (l_suppkey) where r.k < m.n""",
)
def a17(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", (F.row_number().over(w) - 1).alias("k"), "l_orderkey")
    return signal.truncated_to_shortest(rows, "l_suppkey", "l_returnflag", "k")


@query(
    "a02_waveform_mean",
    f"""with m as (select label, channel, avg(value) as m, count(*) as n from (select l.*, e.label from {LONG} l join embeddings e on e.vec_id = l.sample) where label <> 0 group by 1, 2)
    select label, channel, n, round(m * 2.0, 9) as mean from m""",
)
def a02(spark, sf):
    means = units.waveform_means(_signal(spark, sf).where("label <> 0"), ["label"], "values", 2.0)
    return means.select("label", "n", F.posexplode("mean").alias("channel", "mean")).withColumn("mean", F.round("mean", 9))


@query("a03_spike_times", "select user_id, event_type, list(epoch_us(ts) order by epoch_us(ts)) as times from events where event_type <> 'view' group by 1, 2")
def a03(spark, sf):
    return units.spike_times(table(spark, sf, "events").where("event_type <> 'view'").withColumn("us", micros("ts")), ["user_id", "event_type"], "us")


@query("a04_ragged_index", 'with c as (select user_id, count(*) as n from events group by 1) select user_id, n, (sum(n) over (order by user_id))::bigint as "end" from c')
def a04(spark, sf):
    return units.ragged_index(table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"], "n")


@query("a05_units", "select channel, sort_code, row_number() over (order by channel, sort_code)::int - 1 as unit from (select distinct (vec_id % 8)::int as channel, label as sort_code from embeddings where label <> 0)")
def a05(spark, sf):
    s = _signal(spark, sf).select((F.col("sample") % 8).cast("int").alias("channel"), F.col("label").alias("sort_code"))
    return units.units(s)


@query(
    "a07_channel_summary",
    "select l_suppkey, count(*) as snippets, list_sort(list(distinct l_linenumber - 1) filter (l_linenumber <> 1)) as codes from lineitem group by 1",
)
def a07(spark, sf):
    return units.channel_summary(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_linenumber") - 1)


@query("a28_resolution", "select label, 1 / max(10000.0 + vec_id) as resolution from embeddings group by label")
def a28(spark, sf):
    return units.resolution(_signal(spark, sf).withColumn("rate", F.lit(10000.0) + F.col("sample")), "label", "rate")


@query("p22_uniform_length", "select user_id, min(length(event_type)) = max(length(event_type)) as uniform from events group by 1")
def p22(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.split("event_type", "").alias("w"))
    return units.uniform_length(rows, ["user_id"], "w")


@query("x03_blocks", "select vec_id // 128 as block, count(*) as n, round(sum(list_sum(embedding::double[])), 6) as total from embeddings group by 1")
def x03(spark, sf):
    block = F.expr("sample div 128")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return _signal(spark, sf).groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.round(F.sum(total), 6).alias("total"))


@query("k07_chunks", "select vec_id // 100 as chunk, min(vec_id) as first, count(*) as rows from embeddings group by 1")
def k07(spark, sf):
    return _signal(spark, sf).groupBy(F.expr("sample div 100").alias("chunk")).agg(F.min("sample").alias("first"), F.count("*").alias("rows"))


@query("a26_block_rows", "select c_custkey, least((c_nationkey % 8 + 1) * 128, 1000) - (c_nationkey % 8) * 128 as rows from customer")
def a26(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", integrity.block_values(F.lit(1000), 128, F.col("c_nationkey") % 8).alias("rows"))


@query("v16_physical", "select vec_id as sample, round(list_sum(list_transform(embedding, lambda x, i: x::double * 0.5 * (i % 4 + 1) + 0.25)), 6) as total from embeddings")
def v16(spark, sf):
    factors = F.transform(F.sequence(F.lit(1), F.size("values")), lambda i: i % 4 + 1)
    p = integrity.physical(F.col("values"), factors, 0.5, 0.25)
    return _signal(spark, sf).select("sample", F.round(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(
    "w06_square_edges",
    f"with h as (select channel, sample, value > 0 as high, lag(value > 0) over (partition by channel order by sample) as was from {LONG}) select channel, sample from h where high and not was",
)
def w06(spark, sf):
    from spoolwave.operators.edges import square_edges

    return square_edges(signal.long_form(_signal(spark, sf)), "channel", "sample", F.col("value") > 0, 1)


@query("w17_continuity", "select label, min(vec_id) as first, max(vec_id) as last, count(*) as n, max(vec_id) - min(vec_id) + 1 - count(*) as missing from embeddings group by label")
def w17(spark, sf):
    return sections.continuity(_signal(spark, sf), "label", "sample")


@query("n08_volts_per_bit", "select p_partkey, p_retailprice / coalesce(nullif(p_size, 1), 512) as volts from part")
def n08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numeric.volts_per_bit(F.col("p_retailprice"), F.nullif(F.col("p_size"), F.lit(1))).alias("volts"))
