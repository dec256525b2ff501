"""Stores, jobs and the extension surface: what is written comes back, commit markers and reports say so, callers' readers open."""

from __future__ import annotations

import json

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spoolwave.functions.text import output_name
from spoolwave.operators import catalog, pairing
from spoolwave.plans import job, metadata, overlay
from spoolwave.plans.tables import micros, table
from spoolwave.queries.registry import query
from spoolwave.queries.vendor_queries import BASE, LONG, MAKERS, _sums, deposit
from spoolwave.sources import folders, stretches, zarr
from spoolwave.sources.files import file_system, scratch
from spoolwave.sources.store import read_store, write_store


def _session(spark, sf) -> folders.Session:
    """A folder with signals, events and spikes of either half of the vectors."""
    return folders.open_folder(spark, deposit(spark, sf, MAKERS["blackrock"]))


def _halves(spark, sf):
    """Four channels of either half as chunks held in memory, 50 samples each."""
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 2).alias("g"), "vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 8192).cast("float")).alias("raw"))

    def cut(t):
        import pyarrow as pa

        order = np.argsort(t.column("vec_id").to_numpy())
        raw = np.array(t.column("raw").to_pylist(), np.float32)[order]
        out = [(f"half{t.column('g')[0].as_py()}", c, a, raw[a : a + 50, c]) for c in range(4) for a in range(0, len(raw), 50)]
        return pa.table({"recording": [o[0] for o in out], "channel": pa.array([o[1] for o in out], pa.int32()), "first": pa.array([o[2] for o in out], pa.int64()), "values": pa.array([o[3] for o in out], pa.list_(pa.float32()))})

    return rows.groupBy("g").applyInArrow(cut, stretches.CHUNKS)


def _summed(chunks):
    long = stretches.samples(chunks)
    v = F.col("value").cast("double")
    out = long.groupBy(F.regexp_extract("recording", r"(\d)$", 1).cast("bigint").alias("g"), "channel")
    return out.agg(F.count("*").alias("n"), F.sum(v).cast("bigint").alias("total"), F.sum(v * (F.col("sample") % 97)).cast("bigint").alias("mix"))


@query("s09_in_memory", _sums(LONG))
def s09(spark, sf):
    return _summed(folders.Session("memory", chunked=_halves(spark, sf)).chunks())


@query("s10_in_memory_waveforms", f"select g, vec_id % 3 as sort_code, count(*) as spikes, sum(raw[2])::bigint as second from {BASE} where vec_id % 3 <> 0 group by 1, 2")
def s10(spark, sf):
    w = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 2).cast("string").alias("store"), F.lit(0).alias("channel"), (F.col("vec_id") % 3).cast("int").alias("sort_code"), F.col("vec_id").cast("double").alias("t"),
        F.transform(F.slice("embedding", 1, 4), lambda v: F.round(v.cast("double") * 8192).cast("float")).alias("waveform"),
    )
    u = job.units_table(w)
    return u.select(F.col("store").cast("bigint").alias("g"), F.col("sort_code").cast("bigint").alias("sort_code"), "spikes", F.round(F.element_at("mean", 2) * F.col("spikes")).cast("bigint").alias("second"))


@query("k03_zarr_store", _sums(LONG))
def k03(spark, sf):
    path = scratch(spark, "zarr")
    zarr.write(_halves(spark, sf), path, rows=128)
    return _summed(zarr.read(spark, path))


@query("k06_write_mode", "select unnest(['first', 'again', 'overwrite']) as write, unnest([n, -1, n - 1]) as rows from (select count(*) as n from supplier)")
def k06(spark, sf):
    rows, path, done = table(spark, sf, "supplier"), scratch(spark, "mode"), []
    for name, some, over in (("first", rows, False), ("again", rows, False), ("overwrite", rows.where("s_suppkey <> 1"), True)):
        try:
            write_store(some, "mode", path=path, overwrite=over)
            done.append((name, read_store(spark, path).count()))
        except PySparkException:  # a store that exists
            done.append((name, -1))
    return spark.createDataFrame(done, "write string, rows bigint")


@query("k08_session_store", f"select 'r' || g as recording, 4 * count(*) as n from {BASE} group by 1")
def k08(spark, sf):
    path = scratch(spark, "session")
    report = job.Job.of(spark, _session(spark, sf)).write(path)
    rows = spark.createDataFrame(sorted(report.recordings.items()), "recording string, n bigint")
    return rows.groupBy(F.regexp_extract("recording", r"^(r\d)", 1).alias("recording")).agg(F.sum("n").cast("bigint").alias("n"))


@query("k18_report", "select t.name, case t.name when 'ok' then 1 when 'units' then u else n end::bigint as n from (select count(*) as n, count(distinct case when vec_id % 5 <> 0 then (vec_id % 2) || ':' || (vec_id % 5) end) as u from embeddings), (select unnest(['ok', 'events', 'snippets', 'units']) as name) t")
def k18(spark, sf):
    path = scratch(spark, "session")
    job.Job.of(spark, _session(spark, sf)).write(path)
    fs, where = file_system(f"{path}.report.json")
    with fs.open_input_stream(where) as f:
        said = json.loads(f.read())
    return spark.createDataFrame([("ok", int(said["ok"])), *((k, v) for k, v in said["tables"].items() if k != "metadata")], "name string, n bigint")


@query("k10_scalar_store", "select event_type as store, count(distinct epoch_us(ts)) as rows, sum(case when last then value end) as total from (select *, row_number() over (partition by event_type, ts order by event_id desc) = 1 as last from events) group by 1")
def k10(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value", micros("ts").alias("at"), F.lit(1).alias("channel"))
    rows = pairing.scalar_rows(e, "event_type", ["at", "event_id"], "at", "channel", "value", 1)
    back = read_store(spark, write_store(rows, "scalars"))
    return back.groupBy(F.col("event_type").alias("store")).agg(F.count("*").alias("rows"), F.sum(F.element_at("values", 1)).alias("total"))


@query("k14_typed_table", "select unnest(['s_suppkey', 's_name', 's_acctbal']) as name, unnest([true, false, true]) as numeric, unnest([sum(s_suppkey)::double, null, sum(round(s_acctbal, 2))]) as total from supplier")
def k14(spark, sf):
    """Text columns whose every cell is a number are stored as numbers."""
    cols = ["s_suppkey", "s_name", "s_acctbal"]
    texts = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")).select(*[F.col(c).cast("string").alias(c) for c in cols])
    kinds = {r.name: r.numeric for r in catalog.numeric_columns(texts, cols).collect()}
    back = read_store(spark, write_store(texts.select(*[F.col(c).cast("double") if kinds[c] else F.col(c) for c in cols]), "typed"))
    total = [F.sum(c).alias(c) if dict(back.dtypes)[c] == "double" else F.lit(None).cast("double").alias(c) for c in cols]
    wide = back.agg(*total)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("numeric"), F.col(c).alias("total")) for c in cols])).alias("r")).select("r.*")


@query("k19_metadata_file", "select n_name as key, n_regionkey % 2 = 0 as include, 'out' || n_nationkey as out_name from nation")
def k19(spark, sf):
    rows = table(spark, sf, "nation").collect()  # a metadata file is written by hand and read whole
    data = {"streams": {r.n_name: {"include": r.n_regionkey % 2 == 0, "out_name": f"out{r.n_nationkey}", "unit": ""} for r in rows}, "subject": {}}
    path = scratch(spark, "meta") + ".json"
    metadata.write(data, path)
    return metadata.spec(spark, metadata.read(path)).select("key", "include", "out_name")


@query("v03_apply_metadata", "select n_name as name, 'out' || n_nationkey as out_name from nation where n_regionkey % 2 = 0")
def v03(spark, sf):
    n = table(spark, sf, "nation")
    data = {"streams": {r.n_name: {"include": r.n_regionkey % 2 == 0, "out_name": f"out{r.n_nationkey}"} for r in n.collect()}}
    plan, _ = overlay.resolve(n.select(F.col("n_name").alias("name")), metadata.spec(spark, data))
    return plan.select("name", "out_name")


@query("k22_output_name", "select page_id, regexp_replace(url || '.NWB', '(?i)\\.nwb(\\.zarr)?$', '') || '.nwb.zarr' as name from pages")
def k22(spark, sf):
    return table(spark, sf, "pages").select("page_id", output_name(F.concat("url", F.lit(".NWB")), ".nwb.zarr").alias("name"))


@query("v05_column_lengths", "select 'r:' || s_nationkey as target, 'chunks overlap' as message from supplier group by s_nationkey having count(*) > 1")
def v05(spark, sf):
    """Columns of a table that claim the same place twice: each nation's suppliers as chunks that all begin at 0 and 1."""
    s = table(spark, sf, "supplier")
    n = s.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    one = n.select(F.lit("r").alias("recording"), F.col("s_nationkey").cast("int").alias("channel"), F.lit(0).cast("bigint").alias("first"), F.array_repeat(F.lit(1.0).cast("float"), 3).alias("values"))
    two = n.where("n > 1").select(F.lit("r").alias("recording"), F.col("s_nationkey").cast("int").alias("channel"), F.lit(1).cast("bigint").alias("first"), F.array(F.lit(1.0).cast("float")).alias("values"))
    found = job.structural_checks(one.unionByName(two))
    return found.select(F.regexp_extract("target_name", r"^(r:\d+)", 1).alias("target"), "message")


@query("x01_custom_reader", f"select g, count(*) as n, sum(raw[1])::bigint as total from {BASE} group by 1")
def x01(spark, sf):
    """A reader that a caller brings: one int16 column per file, claimed by its suffix."""
    path = deposit(spark, sf, lambda g, ids, raw: {f"half{g}.mine": raw[:, 0].astype("<i2").tobytes()})

    def opens(spark, path):
        from spoolwave.sources.files import listing

        rows = [stretches.stretch(i.base_name, folders._uri(i.path, path), i.size // 2, 0, "<i2", 2, [0]) for i in listing(path, ".mine")[1]]
        return folders.Session("mine", stretches.table(spark, rows))

    session = folders.open_folder(spark, path, [*folders.FOLDERS, folders.Format("mine", lambda p: 0.5, opens)])
    long = stretches.samples(session.chunks())
    return long.groupBy(F.regexp_extract("recording", r"(\d)\.mine", 1).cast("bigint").alias("g")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).cast("bigint").alias("total"))
