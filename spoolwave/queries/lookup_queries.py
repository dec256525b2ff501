"""Point lookups in gapped records, sidecars of many sessions, metadata files, and folders whose kind follows from the rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolwave.plans import metadata
from spoolwave.plans.tables import table
from spoolwave.queries.registry import query
from spoolwave.sources import folders, openephys, tdt
from spoolwave.sources.files import file_system, scratch

# records with gaps

_RECORDS = "(select 'f' || (o_orderkey % 4) as file, o_orderkey // 4 as k, o_orderkey // 4 * 1024 + 300 * (o_orderkey // 4 // 5) as first from orders)"
_POINTS = "(select l_orderkey, l_linenumber, l_extendedprice, 'f' || (l_suppkey % 4) as file, l_orderkey * 280 + l_partkey as sample from lineitem)"


@query(
    "s45_locate",
    f"select l_orderkey, l_linenumber, l_extendedprice, case when sample - first < 1024 then k end as k, case when sample - first < 1024 then sample - first end as \"offset\" from {_POINTS} p asof left join {_RECORDS} r on p.file = r.file and p.sample >= r.first",
)
def s45(spark, sf):
    """Where a sample of each order line lies in records of which every fifth is followed by a gap."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 4).cast("string")).alias("file"), F.floor(F.col("o_orderkey") / 4).alias("k"))
    records = o.withColumn("timestamp", F.col("k") * 1024 + 300 * F.floor(F.col("k") / 5))
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string")).alias("file"), (F.col("l_orderkey") * 280 + F.col("l_partkey")).alias("sample"))
    return openephys.locate(points, records).select("l_orderkey", "l_linenumber", "l_extendedprice", "k", "offset")


_FAR = 10**9
_FLAT = "(select vec_id * 64 + j as i, round(embedding[j + 1]::double * 8192)::int as v from embeddings, (select unnest(range(0, 64)) as j))"


@query(
    "s44_long_gap",
    f"""with r as (select i // 1024 as k, i + case when i // 1024 >= 3 then {_FAR} else 0 end as p, v from {_FLAT}), w as (select unnest([2500, {_FAR} + 2572]) as a, unnest([3500, {_FAR} + 4106]) as b)
    select a as start, b - a as n, (select coalesce(sum(v), 0) from r where p >= a and p < b)::bigint as total, (select coalesce(sum(v * (p % 97)), 0) from r where p >= a and p < b)::bigint as mix from w""",
)
def s44_gap(spark, sf):
    """Two ranges at the ends of a gap of 10^9 samples, which is a row until pieces of it are asked for."""
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v")).select((F.col("vec_id") * 64 + F.col("j")).alias("i"), F.round(F.col("v").cast("double") * 8192).cast("smallint").alias("v"))
    samples = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("samples")
    k = F.floor(F.col("i") / 1024)
    records = long.groupBy(k.alias("k")).agg(samples).where(F.size("samples") == 1024).select(F.lit("f").alias("file"), "k", (F.col("k") * 1024 + F.when(F.col("k") >= 3, _FAR).otherwise(0)).alias("timestamp"), "samples")
    out = []
    for a, b in ((2500, 3500), (_FAR + 2572, _FAR + 4106)):
        rows = openephys.legacy_samples(records, start=a, end=b)
        out.append(rows.agg(F.lit(a).cast("bigint").alias("start"), F.count("*").alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"), F.sum(F.col("value").cast("bigint") * (F.col("sample") % 97)).alias("mix")))
    return out[0].unionByName(out[1])


# sidecars of many sessions


@query(
    "s40_structures",
    """select l_orderkey, 'Rate' || (l_orderkey % 3) as stream, (1000 + l_orderkey)::double as rate, count(*) as channels, sum((l_returnflag = 'A')::int)::bigint as analog,
    round(sum(l_quantity * case l_linestatus when 'O' then 1.0 else 1e-3 end), 6) as gain from lineitem group by 1""",
)
def s40(spark, sf):
    """A structure file per order, its lines as channels, parsed where the rows lie."""
    line = F.struct(F.concat(F.when(F.col("l_returnflag") == "A", "ADC").otherwise("CH"), F.col("l_linenumber").cast("string")).alias("channel_name"), F.col("l_quantity").alias("bit_volts"), F.when(F.col("l_linestatus") == "O", "V").otherwise("mV").alias("units"))
    said = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("channels"))
    stream = F.struct(F.concat(F.lit("Rate"), (F.col("l_orderkey") % 3).cast("string"), F.lit("/")).alias("folder_name"), (1000 + F.col("l_orderkey")).alias("sample_rate"), "channels")
    files = said.select("l_orderkey", F.to_json(F.struct(F.array(stream).alias("continuous"))).alias("text"))
    found = openephys.structures(files)
    gain = F.aggregate("channels", F.lit(0.0), lambda a, c: a + c["gain"])
    return found.select("l_orderkey", "stream", "rate", F.size("channels").cast("bigint").alias("channels"), F.size(F.filter("channels", lambda c: c["role"] == "analog")).cast("bigint").alias("analog"), F.round(gain, 6).alias("gain"))


@query(
    "s41_many_sessions",
    """select o_custkey % 50 as g, count(*) as sessions, sum(o_orderkey % 1000)::bigint as samples, sum(2 * (1 + o_orderkey % 4))::bigint as steps from orders where o_orderkey % 7 <> 0 group by 1""",
)
def s41_many(spark, sf):
    """Stretches of every session at once: a structure file each, and the sizes of the data files that are there."""
    o = table(spark, sf, "orders")
    n = (F.lit(1) + F.col("o_orderkey") % 4).cast("int")
    path = F.concat(F.lit("s/"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    channels = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("CH"), i.cast("string")).alias("channel_name")))
    files = o.select(path.alias("path"), F.to_json(F.struct(F.array(F.struct(F.lit("A").alias("folder_name"), channels.alias("channels"))).alias("continuous"))).alias("text"))
    sizes = o.where("o_orderkey % 7 <> 0").select(F.concat(path, F.lit("/continuous/A/continuous.dat")).alias("path"), (2 * n * (F.col("o_orderkey") % 1000) + 1).alias("bytes"))
    found = openephys.session_stretches(files, sizes)
    cust = F.regexp_extract("recording", r"^(\d+)-", 1).cast("bigint")
    return found.groupBy((cust % 50).alias("g")).agg(F.count("*").alias("sessions"), F.sum("samples").alias("samples"), F.sum("step").alias("steps"))


@query(
    "s43_settings",
    """select l_orderkey, 'v' || max(l_linenumber) as version, string_agg('P_' || l_linenumber || l_returnflag, ',' order by l_linenumber, l_extendedprice) as processors, round(sum(distinct l_linenumber * 10.5::double - l_orderkey), 6) as x from lineitem
    group by l_orderkey having count(*) = count(distinct l_linenumber)""",
)
def s43(spark, sf):
    """A settings file per order: its lines as processors and as probe sites."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_returnflag"))).alias("lines"), F.max("l_linenumber").alias("top"))
    li = li.where(F.size("lines") == F.size(F.array_distinct(F.array_compact(F.transform("lines", lambda r: r["l_linenumber"])))))
    join = lambda what: F.array_join(F.transform("lines", what), " ")
    processors = join(lambda r: F.concat(F.lit('<PROCESSOR name="Sources/P '), r["l_linenumber"].cast("string"), r["l_returnflag"], F.lit('" nodeId="'), r["l_linenumber"].cast("string"), F.lit('"/>')))
    site = lambda value: join(lambda r: F.concat(F.lit("CH"), r["l_linenumber"].cast("string"), F.lit('="'), value(r).cast("string"), F.lit('"')))
    xs, ys = site(lambda r: r["l_linenumber"] * 10.5), site(lambda r: F.col("l_orderkey"))
    text = F.concat(F.lit("<SETTINGS><INFO><VERSION>v"), F.col("top").cast("string"), F.lit("</VERSION></INFO><SIGNALCHAIN>"), processors, F.lit("<ELECTRODE_XPOS "), xs, F.lit("/><ELECTRODE_YPOS "), ys, F.lit("/></SIGNALCHAIN></SETTINGS>"))
    found = openephys.settings_rows(li.select("l_orderkey", text.alias("text")))
    names = F.array_join(F.transform(F.array_sort(F.map_keys("processors")), lambda k: F.col("processors")[k]), ",")
    x = F.aggregate(F.map_values("sites"), F.lit(0.0), lambda a, s: a + s["x"] - s["y"])
    return found.select("l_orderkey", "version", names.alias("processors"), F.round(x, 6).alias("x"))


# metadata


@query(
    "s58_unknown_keys",
    """select s_suppkey, unnest(list_filter([case when s_suppkey % 5 = 0 then 'unknown key extra' end, case when s_nationkey % 3 = 1 then 'unknown key streams.gain' end, case when s_suppkey % 4 = 1 then 'unknown key subject.colour' end, case when s_suppkey % 6 = 2 then 'subject.sex' end], lambda x: x is not null)) as fault from supplier""",
)
def s58(spark, sf):
    """A metadata file per supplier, some with keys or a sex that no file may have."""
    s = table(spark, sf, "supplier")
    part = lambda test, text: F.when(test, F.lit(text)).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"subject": {"id": "'), F.col("s_name"), F.lit('", "sex": "'), F.when(F.col("s_suppkey") % 6 == 2, "X").otherwise("F"), F.lit('"'), part(F.col("s_suppkey") % 4 == 1, ', "colour": 1'),
        F.lit('}, "streams": {"a": {"unit": "V"}, "*": {"include": true'), part(F.col("s_nationkey") % 3 == 1, ', "gain": 2'), F.lit("}}"), part(F.col("s_suppkey") % 5 == 0, ', "extra": {}'), F.lit("}"),
    )
    return metadata.faults(s.select("s_suppkey", text.alias("text")))


@query(
    "k21_subject",
    """with s as (select c_custkey, c_name as id, case when c_acctbal < 0 then 'M' else 'U' end as sex, case when c_custkey % 3 = 0 then 'P' || c_custkey || 'D' end as age, case when c_custkey % 2 = 0 then c_mktsegment else n_name end as species from customer join nation on n_nationkey = c_nationkey)
    select * from (select c_custkey, unnest(['age', 'age_reference', 'id', 'sex', 'species']) as field, unnest([age, case when age is not null then 'birth' end, id, sex, species]) as value from s) where value is not null""",
)
def k21(spark, sf):
    """Customers as subjects: what is stated goes over what the nation's record says."""
    c = table(spark, sf, "customer")
    stated = c.select("c_custkey", F.col("c_name").alias("id"), F.when(F.col("c_acctbal") < 0, "M").alias("sex"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("P"), F.col("c_custkey").cast("string"), F.lit("D"))).alias("age"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("species"))
    recorded = c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit("old").alias("id"), F.col("n_name").alias("species"))
    return metadata.subjects(stated, recorded, "c_custkey")


@query("k17_commit_marker", "select o_orderstatus as store, count(*) filter (where o_orderkey % 1000 = 77 and o_orderstatus = (select o_orderstatus from orders where o_orderkey = 77)) = 0 as marked, case when marked then count(*) else 0 end as rows from orders group by 1")
def k17(spark, sf):
    """A store per status; the one in which a row cannot be written has no marker and no rows."""
    rows, out = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), []
    worst = rows.where("o_orderkey = 77").select(F.col("o_orderstatus").alias("_bad"))
    told = rows.join(F.broadcast(worst), F.col("o_orderstatus") == F.col("_bad"), "left").withColumn("o_orderkey", F.when(F.col("_bad").isNotNull() & (F.col("o_orderkey") % 1000 == 77), F.raise_error(F.lit("stopped"))).otherwise(F.col("o_orderkey")).cast("bigint")).drop("_bad")
    for status in [r[0] for r in rows.select("o_orderstatus").distinct().collect()]:
        path = scratch(spark, "marker")
        try:
            told.where(F.col("o_orderstatus") == status).write.parquet(path)
        except PySparkException:
            pass
        fs, where = file_system(path)
        marked = fs.get_file_info(f"{where}/_SUCCESS").is_file
        out.append((status, marked, spark.read.parquet(path).count() if marked else 0))
    return spark.createDataFrame(out, "store string, marked boolean, rows bigint")


# folders whose kind follows from the rows


def place(files: DataFrame, root: str) -> int:
    """Write (name, data) as files below a folder, on executors; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist()):
                fs, at = file_system(f"{root}/{name}")
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at, compression=None) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", "data").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]


#: A file that each of four formats knows its folder by, in the order of n_nationkey % 4.
_SIGNS = (("b.tsq", bytes(40)), ("structure.oebin", b"{}"), ("100_CH1.continuous", bytes(1024)), ("x.rhd", struct.pack("<I", folders.intan.RHD) + bytes(40)))


def _sign(key, of: int):
    return F.element_at(F.array(*[F.lit(x[of]) for x in _SIGNS]), (key % 4 + 1).cast("int"))


@query("s03_best_claim", "select n_nationkey, ['tdt', 'openephys', 'openephys-legacy', 'intan'][n_nationkey % 4 + 1] as format, 1 + (n_regionkey = 2 and n_nationkey % 4 <> 2)::int as claims from nation")
def s03(spark, sf):
    """A folder per nation; those of one region also hold a weaker sign, which must not win."""
    n, root = table(spark, sf, "nation"), scratch(spark, "claims")
    own = n.select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit("/"), _sign(F.col("n_nationkey"), 0)).alias("name"), _sign(F.col("n_nationkey"), 1).alias("data"))
    weak = n.where("n_regionkey = 2 and n_nationkey % 4 <> 2").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit("/101_CH2.continuous")).alias("name"), F.lit(bytes(1024)).alias("data"))
    place(own.unionByName(weak), root)
    found = [(r.n_nationkey, folders.claims(f"{root}/{r.n_nationkey}")) for r in n.select("n_nationkey").collect()]
    return spark.createDataFrame([(k, c[0][0], len(c)) for k, c in found], "n_nationkey bigint, format string, claims int")


@query("s04_containers", "select n_regionkey, ['tdt', 'openephys', 'openephys-legacy', 'intan'][n_regionkey % 4 + 1] as format, case when n_regionkey % 4 = 2 then 1 else count(*) end as containers from nation group by 1")
def s04(spark, sf):
    """A folder per region, a container for each of its nations."""
    n, root = table(spark, sf, "nation"), scratch(spark, "containers")
    region = F.col("n_regionkey")
    place(n.select(F.concat(region.cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/"), _sign(region, 0)).alias("name"), _sign(region, 1).alias("data")), root)
    found = [(r.n_regionkey, folders.claims(p := f"{root}/{r.n_regionkey}")[0][0], len(folders.containers(p))) for r in n.select("n_regionkey").distinct().collect()]
    return spark.createDataFrame(found, "n_regionkey bigint, format string, containers int")


@query(
    "v11_conformance",
    """with b as (select o_custkey % 8 as g, o_orderkey // 1000 as block, max((o_orderkey % 1000 = 500 and o_custkey % 8 = 3)::int) as late, max((o_orderkey % 2000 = 1001 and o_custkey % 8 = 5)::int) as gone, count(*) as n from orders group by 1, 2)
    select g, case when g = 3 and max(late) = 1 then 'events' when g = 5 and max(gone) = 1 then 'signals' end as fault from b group by 1""",
)
def v11(spark, sf):
    """Sessions made from the orders of eight groups of customers, with a null value or a step back where certain orders lie."""
    o, out = table(spark, sf, "orders").withColumn("g", F.col("o_custkey") % 8), []
    for g in [r.g for r in o.select("g").distinct().collect()]:
        own = o.where(F.col("g") == g)
        events = own.select(F.lit("e").alias("series"), F.col("o_orderkey").alias("_k"), (F.col("o_orderkey") - F.when((F.col("o_orderkey") % 1000 == 500) & (F.col("g") == 3), 10**6).otherwise(0)).cast("double").alias("onset"))
        events = _numbered(events)
        broken = (F.col("o_orderkey") % 2000 == 1001) & (F.col("g") == 5)
        blocks = own.groupBy(F.lit("r").alias("recording"), F.lit(0).alias("channel")).agg(F.lit(0).cast("bigint").alias("first"), F.array_repeat(F.lit(1.0).cast("float"), 4).alias("values"), F.max(broken.cast("int")).alias("_bad"))
        chunks = blocks.withColumn("values", F.when(F.col("_bad") == 0, F.col("values"))).drop("_bad")
        bad = folders.conforms(folders.Session("made", chunked=chunks, events=events))
        out.append((g, bad[0].split(":")[0] if bad else None))
    return spark.createDataFrame(out, "g bigint, fault string")


def _numbered(events: DataFrame) -> DataFrame:
    from spoolwave.operators.ranking import ranked

    return ranked(events, [F.col("_k")], "pos").select("series", (F.col("pos") - 1).alias("pos"), "onset")


# event records


@query("s15_event_values", "select event_type, count(*) as n, round(sum(value), 2) as total, min(event_id)::double as first from (select event_type, event_id, round(value, 3) as value from events) group by 1")
def s15(spark, sf):
    """Events as index records of eight files, whose values are read back bit by bit."""
    kind = np.dtype(tdt.EVENT_FIELDS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.zeros(batch.num_rows, kind)
            r["type"], r["name"] = 0x201, [n.encode()[:4] for n in batch.column("event_type").to_pylist()]
            r["timestamp"], r["value"] = batch.column("event_id").to_numpy(), batch.column("value").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([f"{batch.column('event_id')[0].as_py()}.tsq"]), pa.array([r.tobytes()])], names=["name", "data"])

    root = scratch(spark, "events")
    e = table(spark, sf, "events").select("event_type", "event_id", F.round("value", 3).alias("value"))
    place(e.repartition(8, "event_id").mapInArrow(write, "name string, data binary"), root)
    names = table(spark, sf, "events").select("event_type").distinct().select("event_type", F.substring("event_type", 1, 4).alias("name"))
    rows = tdt.epoc_values(spark, root, split_bytes=4096)
    return rows.join(F.broadcast(names), "name").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("timestamp").alias("first"))
