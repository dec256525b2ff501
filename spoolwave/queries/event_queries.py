"""Event series: `events` by user or type, `orders` as records of customers, `lineitem` as a packet index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolwave.functions import numeric
from spoolwave.operators import align, edges, pairing, sections
from spoolwave.plans.tables import micros, table, with_prefix_sum
from spoolwave.queries.registry import query

EV = "(select event_id, epoch_us(ts) as us, user_id, event_type, value, props from events)"
RISE = f"(select user_id, event_id, us, event_type = 'signup' as rising from {EV} where event_type in ('signup', 'error'))"
FLIPS = f"(select *, coalesce(lag(rising) over (partition by user_id order by event_id), false) as was from {RISE})"
HIGH = f"(select user_id, us as onset, nxt, rising from (select *, lead(us) over (partition by user_id order by event_id) as nxt from {FLIPS} where rising <> was) where rising)"
WORDS = f"(select user_id, event_id, us, floor(value * 100)::bigint % 64 as w from {EV})"
END = 1800000000000000


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("us", micros("ts")).drop("ts")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).where(F.col("event_type").isin("signup", "error")).withColumn("rising", F.col("event_type") == "signup")


def _word(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).withColumn("w", F.floor(F.col("value") * 100) % 64)


_TRANS = f"""t as (select user_id, us, w, coalesce(lag(w) over (partition by user_id order by us), 0) as p from {WORDS}),
r as (select user_id, us, b::int as bit, (w >> b) & 1 = 1 as rising from t, (select unnest(range(16)) as b) where ((w >> b) & 1) <> ((p >> b) & 1)),
f as (select user_id, min(us) as first from {EV} group by 1),
k as (select r.* from r join f using (user_id) where not ((select 1) is null) and (user_id, bit) not in (select (user_id, bit) from (select user_id, bit, count(*) as n, min(us) as m from r group by 1, 2) join f using (user_id) where n = 1 and m = first))"""


@query("w01_transitions", f"with {_TRANS} select user_id, bit, us, rising from k")
def w01(spark, sf):
    return edges.transitions(_word(spark, sf), "user_id", "us", "w")


@query(
    "w02_periods",
    f"""with {_TRANS}, o as (select *, lead(us) over (partition by user_id, bit order by us) as nxt, lead(rising) over (partition by user_id, bit order by us) as nr from k)
    select user_id, bit, us as onset, case when not nr then nxt else {END} end as "offset" from o where rising""",
)
def w02(spark, sf):
    return edges.periods(edges.transitions(_word(spark, sf), "user_id", "us", "w"), ["user_id", "bit"], "us", "rising", F.lit(END))


@query("w03_open_periods", f'select user_id, onset, nxt as "offset" from {HIGH}')
def w03(spark, sf):
    return edges.high_periods(_changes(spark, sf), ["user_id"], ["event_id"], "us", "rising")


@query("w04_ttl", f'select user_id, onset, coalesce(nxt, {END}) as "offset" from {HIGH}')
def w04(spark, sf):
    return edges.high_periods(_changes(spark, sf), ["user_id"], ["event_id"], "us", "rising", F.lit(END))


@query("w05_ttl_clamped", f'select user_id, onset, coalesce(nxt, greatest(1704500000000000, onset)) as "offset" from {HIGH}')
def w05(spark, sf):
    return edges.high_periods(_changes(spark, sf), ["user_id"], ["event_id"], "us", "rising", F.lit(1704500000000000), clamp=True)


_GAP = "sum(gap) over (partition by user_id order by event_id)"


@query(
    "w07_sections",
    f"""with g as (select *, case when abs(us - lag(us) over (partition by user_id order by event_id) - 60000000) > 36000000000 then 1 else 0 end as gap from {EV}),
    s as (select *, {_GAP} as section from g)
    select user_id, section::bigint as section, min(event_id) as first, max(event_id) as last, arg_min(us, event_id) as start, sum(length(event_type))::bigint as samples from s group by 1, 2""",
)
def w07(spark, sf):
    return sections.gap_sections(_events(spark, sf), "user_id", "event_id", "us", F.length("event_type"), F.lit(60000000), F.lit(36000000000))


@query(
    "a13_measured_rate",
    f"""with g as (select *, case when abs(us - lag(us) over (partition by user_id order by event_id) - 60000000) > 36000000000 then 1 else 0 end as gap from {EV}),
    s as (select *, {_GAP} as section from g),
    x as (select user_id, section, min(event_id) as first, max(event_id) as last, arg_min(us, event_id) as start, sum(length(event_type)) as samples from s group by 1, 2),
    m as (select * from (select *, row_number() over (partition by user_id order by last - first desc, first desc) as k from x) where k = 1)
    select m.user_id, case when last <> first then (samples - length(e.event_type)) * 1e6 / (e.us - start) end as rate from m join {EV} e on e.event_id = m.last""",
)
def a13(spark, sf):
    ev = _events(spark, sf)
    runs = sections.gap_sections(ev, "user_id", "event_id", "us", F.length("event_type"), F.lit(60000000), F.lit(36000000000))
    return sections.measured_rate(runs, ev, "user_id", "event_id", "us", F.length("event_type"))


@query(
    "w08_parts",
    f"""with g as (select *, case when us - lag(us) over (partition by event_type order by event_id) > 3600000000 then 1 else 0 end as gap from {EV}),
    s as (select *, sum(gap) over (partition by event_type order by event_id) as part from g)
    select event_type, part::bigint as part, arg_min(us, event_id) as start, count(*) as samples from s group by 1, 2""",
)
def w08(spark, sf):
    return sections.parts(_events(spark, sf), "event_type", "event_id", "us", F.lit(3600000000))


@query(
    "w10_part_epochs",
    """with p as (select o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 as s, floor(o_totalprice)::bigint as len from orders),
    r as (select *, case when s + 86400 < lag(s + len) over (partition by o_custkey order by o_orderkey) then 1 else 0 end as reset from p)
    select o_custkey, o_orderkey, (sum(reset) over (partition by o_custkey order by o_orderkey))::bigint as epoch from r""",
)
def w10(spark, sf):
    o = table(spark, sf, "orders")
    start, length = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000"), F.floor("o_totalprice")
    return sections.part_epochs(o, "o_custkey", ["o_orderkey"], start, length, 86400).select("o_custkey", "o_orderkey", "epoch")


@query(
    "w09_epochs",
    """with recursive p as (select user_id, event_id, floor(value * 1000)::bigint as t, row_number() over (partition by user_id order by event_id) as k from events),
    r as (select user_id, event_id, t, k, 0 as epoch, t as mx from p where k = 1
      union all select p.user_id, p.event_id, p.t, p.k, case when p.t + 20000 < r.mx then r.epoch + 1 else r.epoch end, case when p.t + 20000 < r.mx then p.t else greatest(r.mx, p.t) end
      from r join p on p.user_id = r.user_id and p.k = r.k + 1)
    select user_id, event_id, t as ticks, epoch::bigint as epoch from r""",
)
def w09(spark, sf):
    ev = _events(spark, sf).withColumn("ticks", F.floor(F.col("value") * 1000))
    return sections.clock_epochs(ev, "user_id", "event_id", "ticks", 20000)


@query("w11_sequence", "select event_id, row_number() over (order by event_id) - 1 as seq from events where event_type <> 'view'")
def w11(spark, sf):
    named = _events(spark, sf).where("event_type <> 'view'").select("event_id")
    return with_prefix_sum(named, "event_id", F.lit(1), "seq", span=512)


@query("w12_offsets", "select event_id, coalesce(sum(length(event_type)) over (order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from events")
def w12(spark, sf):
    return with_prefix_sum(_events(spark, sf).select("event_id", "event_type"), "event_id", F.length("event_type"), "before", span=512).select("event_id", "before")


@query("w13_file_starts", "select o_custkey, o_orderkey, coalesce(sum(floor(o_totalprice)::bigint) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as start from orders")
def w13(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.sum(F.floor("o_totalprice")).over(w), F.lit(0)).alias("start"))


_REG = "(select user_id, case when user_id % 2 = 0 then 1000000.0 * row_number() over (partition by user_id order by event_id) + 5 else us::double end as t from " + EV + ")"


@query(
    "w14_regular_rate",
    f"""with s as (select user_id, t - lag(t) over (partition by user_id order by t) as d from {_REG}), m as (select user_id, min(t) as t0, max(t) as t1, count(*) as n from {_REG} group by 1),
    x as (select user_id, min(d) as lo, max(d) as hi from s where d is not null group by 1)
    select m.user_id, t0 as start, case when n >= 3 and (t1 - t0) / (n - 1) > 0 and greatest(hi - (t1 - t0) / (n - 1), (t1 - t0) / (n - 1) - lo) <= (t1 - t0) / (n - 1) * 1e-4 then 1 / ((t1 - t0) / (n - 1)) end as rate
    from m left join x using (user_id)""",
)
def w14(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = F.when(F.col("user_id") % 2 == 0, 1000000.0 * F.row_number().over(w) + 5).otherwise(F.col("us").cast("double"))
    return sections.regular_rate(_events(spark, sf).select("user_id", t.alias("t")), "user_id", "t")


@query("w15_time_order", "select o_custkey, count(*) filter (was > d) as backwards from (select o_custkey, o_orderdate as d, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as was from orders) group by 1")
def w15(spark, sf):
    return sections.out_of_order(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@query(
    "w16_contiguous",
    "select user_id, coalesce(bool_and(d = 1), true) as contiguous, coalesce(bool_or(d < 0), false) as backwards from (select user_id, (floor(value)::int - lag(floor(value)::int) over (partition by user_id order by event_id)) as d from events) group by 1",
)
def w16(spark, sf):
    ev = _events(spark, sf).select("user_id", F.col("event_id").alias("_pos"), F.floor("value").cast("int").alias("v"))
    return sections.contiguous(ev, "user_id", "v", 1)


@query("w20_ordinal_names", "select p_partkey, p_brand || case when k = 1 then '' else '_' || k end as name from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as k from part)")
def w20(spark, sf):
    return sections.ordinal_names(table(spark, sf, "part"), ["p_brand"], ["p_partkey"], F.col("p_brand")).select("p_partkey", "name")


@query("w23_part_names", "select p_partkey, p_name || case when n = 1 then '' else '.p' || k end as name from (select p_partkey, p_name, row_number() over w as k, count(*) over (partition by p_name, p_size) as n from part window w as (partition by p_name, p_size order by p_partkey))")
def w23(spark, sf):
    return sections.ordinal_names(table(spark, sf, "part"), ["p_name", "p_size"], ["p_partkey"], F.col("p_name"), first_plain=False).select("p_partkey", "name")


@query("w21_chunk", "select event_id // 1000 as chunk, count(*) as n, min(epoch_us(ts)) as start from events group by 1")
def w21(spark, sf):
    return _events(spark, sf).groupBy(F.expr("event_id div 1000").alias("chunk")).agg(F.count("*").alias("n"), F.min("us").alias("start"))


@query("w22_midnight", "with t as (select event_id, epoch_us(ts) // 1000000 % 86400 as c from events) select event_id, case when c < 50000 then c + 86400 else c end - 50000 as onset from t")
def w22(spark, sf):
    clock = F.expr("us div 1000000") % 86400
    return _events(spark, sf).select("event_id", pairing.after_midnight(clock, F.lit(50000)).alias("onset"))


@query("w24_consecutive", "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as was from events) where was is null or was <> event_type")
def w24(spark, sf):
    return sections.consecutive_distinct(_events(spark, sf), "user_id", ["event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("w25_line_events", f'select user_id, count(*) as n, sum(coalesce(nxt, {END}) - onset)::bigint as high from {HIGH} group by 1')
def w25(spark, sf):
    p = edges.high_periods(_changes(spark, sf), ["user_id"], ["event_id"], "us", "rising", F.lit(END))
    return p.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("offset") - F.col("onset")).alias("high"))


_NEAR = f"""a as (select user_id, us from {EV} where event_type = 'click'), b as (select user_id, us from {EV} where event_type = 'purchase'),
n as (select a.user_id, a.us, b.us as near, row_number() over (partition by a.user_id, a.us order by abs(b.us - a.us), b.us) as k from a join b using (user_id)),
m as (select user_id, us, near from n where k = 1 and abs(near - us) <= 20000000000)"""


def _near(spark, sf):
    ev = _events(spark, sf)
    return align.nearest(ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'"), "user_id", "us", 20000000000)


@query("j12_nearest_asof", f"with {_NEAR} select user_id, us, near from m")
def j12(spark, sf):
    return _near(spark, sf)


@query(
    "a12_clock_fit",
    f"""with {_NEAR}, s as (select user_id, us / 1e6 - 1704067200 as x, near / 1e6 - 1704067200 as y from m),
    f as (select user_id, avg(x) as mx, avg(y) as my, regr_slope(y, x) as b, count(*) as n, var_pop(x) as v from s group by 1)
    select user_id, round(b, 6) as scale, round(my - b * mx, 3) as "offset", n as edges, round(max(abs(y - my - b * (x - mx))), 3) as residual from s join f using (user_id) where n >= 2 and v > 0 group by 1, b, my, mx, n""",
)
def a12(spark, sf):
    s = _near(spark, sf).select("user_id", (F.col("us") / 1e6 - 1704067200).alias("x"), (F.col("near") / 1e6 - 1704067200).alias("y"))
    fit = align.clock_fit(s, "user_id", "x", "y")
    return fit.select("user_id", F.round("scale", 6).alias("scale"), F.round("offset", 3).alias("offset"), "edges", F.round("residual", 3).alias("residual"))


@query("n22_clock_apply", f"select event_id, 1.00001 * (us / 1e6) + (-0.002) as t from {EV}")
def n22(spark, sf):
    return _events(spark, sf).select("event_id", align.apply_clock(F.col("us") / 1e6, F.lit(1.00001), F.lit(-0.002)).alias("t"))


@query(
    "j14_range_lookup",
    f"""with r as (select user_id, event_id as rid, us as s, lead(us) over (partition by user_id order by us) as e from {EV} where event_type = 'signup')
    select p.user_id, p.event_id, p.us, r.rid from {EV} p join r on p.user_id = r.user_id and p.us >= r.s and (r.e is null or p.us < r.e) where p.event_type = 'view'""",
)
def j14(spark, sf):
    ev = _events(spark, sf)
    points = ev.where("event_type = 'view'").select("user_id", "event_id", "us")
    ranges = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("rid"), F.col("us").alias("s"))
    return align.range_lookup(points, ranges, "user_id", "us", "s", ["rid"])


@query(
    "j15_markers",
    f"select event_type, us, (us - 1704100000000000.0) / 600000000000.0 as position from (select *, row_number() over (partition by event_type order by us) as k from {EV} where us >= 1704100000000000.0 and us < 1704700000000000.0) where k <= 40",
)
def j15(spark, sf):
    return align.markers(_events(spark, sf), "event_type", "us", 1704100000000000.0, 600000000000.0, 40)


@query(
    "j16_inside",
    f"""with s as (select user_id, us as a, us + 7200000000 as b from {EV} where event_type = 'signup')
    select e.user_id, e.event_id, e.us, exists (select 1 from s where s.user_id = e.user_id and e.us between s.a and s.b) as inside from {EV} e where e.event_type = 'click'""",
)
def j16(spark, sf):
    ev = _events(spark, sf)
    segs = ev.where("event_type = 'signup'").select("user_id", F.col("us").alias("a"), (F.col("us") + 7200000000).alias("b"))
    return align.inside_segments(ev.where("event_type = 'click'").select("user_id", "event_id", "us"), segs, "user_id", "us", "a", "b")


@query("j21_common_range", 'select user_id, max(a) as first, min(b) as "end" from (select user_id, event_type, min(epoch_us(ts)) as a, max(epoch_us(ts)) as b from events group by 1, 2) group by 1')
def j21(spark, sf):
    per = _events(spark, sf).groupBy("user_id", "event_type").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return align.common_range(per, "user_id", "a", "b")


@query(
    "j07_pair_offsets",
    f"""with a as (select user_id, us, row_number() over (partition by user_id order by us) as k, count(*) over (partition by user_id) as n from {EV} where event_type = 'click'),
    b as (select user_id, us, row_number() over (partition by user_id order by us) as k from {EV} where event_type = 'view'), m as (select user_id, count(*) as m from b group by 1)
    select a.user_id, a.k as pos, a.us as onset, case when coalesce(m, 0) = n then b.us when coalesce(m, 0) + 1 = n then coalesce(b.us, {END}) end as "offset"
    from a left join m using (user_id) left join b on b.user_id = a.user_id and b.k = a.k""",
)
def j07(spark, sf):
    ev = _events(spark, sf)
    return pairing.pair_offsets(ev.where("event_type = 'click'"), ev.where("event_type = 'view'"), "user_id", "us", F.lit(END)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "j08_notes",
    """with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from events), n as (select conv_id, text, row_number() over (partition by conv_id order by turn) as k from conversations)
    select e.user_id, e.event_id, coalesce(n.text, '') as label from e left join n on n.conv_id = e.user_id and n.k = e.k""",
)
def j08(spark, sf):
    notes = table(spark, sf, "conversations").withColumnRenamed("conv_id", "user_id")
    return pairing.attach_labels(_events(spark, sf).select("user_id", "event_id"), notes, "user_id", ["event_id"], ["turn"], "text")


@query(
    "a11_scalars",
    """with r as (select event_type, event_id, date_trunc('hour', ts) as h, user_id % 4 as c, value from events),
    g as (select *, case when lag(h) over (partition by event_type order by event_id) = h then 0 else 1 end as nw from r),
    k as (select *, sum(nw) over (partition by event_type order by event_id) as row from g)
    select event_type, row::bigint as row, epoch_us(min(h)) as at, coalesce(arg_max(value, event_id) filter (greatest(1, least(3, c)) = 1), 'nan'::double) as c1,
    coalesce(arg_max(value, event_id) filter (greatest(1, least(3, c)) = 2), 'nan'::double) as c2, coalesce(arg_max(value, event_id) filter (greatest(1, least(3, c)) = 3), 'nan'::double) as c3 from k group by 1, 2""",
)
def a11(spark, sf):
    ev = _events(spark, sf).withColumn("h", F.expr("us div 3600000000 * 3600000000")).withColumn("c", F.col("user_id") % 4)
    rows = pairing.scalar_rows(ev, "event_type", ["event_id"], "h", "c", "value", 3)
    return rows.select("event_type", "row", "at", *[F.element_at("values", i).alias(f"c{i}") for i in (1, 2, 3)])


@query("a08_duration", "select o_custkey, coalesce(max(epoch_us(o_orderdate) / 1e6 + o_totalprice / 25.0), 0) as duration from orders group by 1")
def a08(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(micros("o_orderdate") / 1e6 + F.col("o_totalprice") / 25.0), F.lit(0.0)).alias("duration"))


@query("a10_time_zero", "select min(t) as zero from (select min(epoch_us(ts)) as t from events union all select min(epoch_us(o_orderdate)) from orders)")
def a10(spark, sf):
    a = _events(spark, sf).agg(F.min("us").alias("t"))
    b = table(spark, sf, "orders").agg(F.min(micros("o_orderdate")).alias("t"))
    return a.unionByName(b).agg(F.min("t").alias("zero"))


@query("a16_counts", "select event_type, count(*) as n from events group by 1")
def a16(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a18_warnings", "select list(c || ' x ' || event_type order by event_type) as said from (select event_type, count(*) as c from events where value > 90 group by 1)")
def a18(spark, sf):
    g = _events(spark, sf).where("value > 90").groupBy("event_type").agg(F.count("*").alias("c"))
    said = F.struct("event_type", F.concat(F.col("c").cast("string"), F.lit(" x "), "event_type").alias("s"))
    return g.agg(F.transform(F.array_sort(F.collect_list(said)), lambda r: r["s"]).alias("said"))


@query("a22_extent", "select min(o_orderdate) as start, max(epoch_us(o_orderdate) + o_orderkey) as stop from orders")
def a22(spark, sf):
    return table(spark, sf, "orders").agg(F.min("o_orderdate").alias("start"), F.max(micros("o_orderdate") + F.col("o_orderkey")).alias("stop"))


@query("a25_relative", "select user_id, min(epoch_us(ts)) - (select min(epoch_us(ts)) from events) as start from events group by 1")
def a25(spark, sf):
    ev = _events(spark, sf)
    zero = ev.agg(F.min("us").alias("_zero"))
    return ev.groupBy("user_id").agg(F.min("us").alias("_t")).crossJoin(F.broadcast(zero)).select("user_id", (F.col("_t") - F.col("_zero")).alias("start"))


@query("a24_last_measured", "select user_id, arg_max(value, event_id) filter (value >= 20) as value from events group by 1")
def a24(spark, sf):
    from spoolwave.operators.catalog import last_measured

    return last_measured(_events(spark, sf).withColumn("value", F.when(F.col("value") >= 20, F.col("value")).otherwise(-1.0)), "user_id", ["event_id"], "value")


@query("n20_ticks", f"select event_id, (us - 1704067200000000) / 30000.0 as seconds from {EV}")
def n20(spark, sf):
    return _events(spark, sf).select("event_id", numeric.ticks_to_seconds(F.col("us"), F.lit(1704067200000000), F.lit(30000.0)).alias("seconds"))


@query("p15_short_parts", "select o_custkey, count(*) as samples from orders group by 1 having count(*) >= 2")
def p15(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("samples")).where("samples >= 2")


@query("p16_named_records", "select event_id, row_number() over (order by event_id) - 1 as seq from events where user_id <> 0")
def p16(spark, sf):
    return with_prefix_sum(_events(spark, sf).where("user_id <> 0").select("event_id"), "event_id", F.lit(1), "seq", span=512)


@query("p17_valid_types", "select event_id, case when (v & 240) <> 0 then null when v = 1 then 'onset' when v in (2, 6) then 'offset' else 'scalar' end as kind from (select event_id, floor(value)::int % 40 as v from events)")
def p17(spark, sf):
    v = F.floor("value").cast("int") % 40
    kind = F.when(v.bitwiseAND(F.lit(240)) != 0, F.lit(None)).when(v == 1, "onset").when(v.isin(2, 6), "offset").otherwise("scalar")
    return _events(spark, sf).select("event_id", kind.alias("kind"))


@query("o02_sorted_events", "select event_type, list(event_id order by value, event_id) as ids from events group by 1")
def o02(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("value", "event_id")))
    return _events(spark, sf).groupBy("event_type").agg(F.transform(ordered, lambda s: s["event_id"]).alias("ids"))


@query("o08_first_n", "select event_type, event_id, value from (select *, row_number() over (partition by event_type order by event_id) as k from events) where k <= 3")
def o08(spark, sf):
    w = Window.partitionBy("event_type").orderBy("event_id")
    return _events(spark, sf).withColumn("_k", F.row_number().over(w)).where("_k <= 3").select("event_type", "event_id", "value")


@query("u01_union_lines", "select user_id, event_type, list(epoch_us(ts) order by epoch_us(ts)) as onsets from events where event_type in ('signup', 'error') group by 1, 2")
def u01(spark, sf):
    ev = _events(spark, sf)
    both = ev.where("event_type = 'signup'").unionByName(ev.where("event_type = 'error'"))
    return both.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("us")).alias("onsets"))


@query("u06_distinct_lines", "select distinct abs(floor(value)::int - 50) as line from events where floor(value)::int <> 50")
def u06(spark, sf):
    return _events(spark, sf).select(F.abs(F.floor("value").cast("int") - 50).alias("line")).where("line > 0").distinct()


@query("t26_json", "select event_id, coalesce((props->>'k')::int, 0) as k from events")
def t26(spark, sf):
    return _events(spark, sf).select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(0)).alias("k"))
