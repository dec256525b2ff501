"""The transactional sink, verification by blocks, cancelling and progress, request checks."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolwave.operators import integrity
from spoolwave.plans import job
from spoolwave.plans.tables import table
from spoolwave.queries.registry import query
from spoolwave.sources import recordings, stretches, zarr
from spoolwave.sources.files import checkpoint, file_system, scratch

#: Orders as three recordings of one channel: order i is sample i / 3 of recording i % 3, in chunks of 64 samples.
ORDERS = "(select 'r' || (o_orderkey % 3) as recording, o_orderkey // 3 as sample, o_orderkey // 3 // 64 as block, o_custkey as v from orders)"


def order_chunks(spark, sf, kind: str = "float") -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")).alias("recording"), F.floor(F.col("o_orderkey") / 3).alias("sample"), F.col("o_custkey").alias("v"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("sample", "v"))), lambda s: s["v"].cast(kind)).alias("values")
    return o.groupBy("recording", F.floor(F.col("sample") / 64).alias("block")).agg(values).select("recording", F.lit(0).alias("channel"), (F.col("block") * 64).alias("first"), "values")


def vector_chunks(spark, sf) -> DataFrame:
    """Every component of the vectors as a channel, 64 vectors a chunk."""
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "v"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("values")
    return long.groupBy("channel", F.floor(F.col("vec_id") / 64).alias("block")).agg(values).select(F.lit("emb").alias("recording"), "channel", (F.col("block") * 64).alias("first"), "values")


def _exact(chunks: DataFrame) -> DataFrame:
    v = F.round(F.col("value").cast("double") * 8192)
    return stretches.samples(chunks).agg(F.count("*").alias("n"), F.sum(v).cast("bigint").alias("total"), F.sum(v * (F.col("sample") % 97) * (F.col("channel") % 7 + 1)).cast("bigint").alias("mix"))


def left(path: str) -> int:
    """Files and folders of a store and of what was written on the way to it."""
    import pyarrow.fs as pafs

    fs, base = file_system(path)
    folder, name = base.rsplit("/", 1)
    return sum(i.base_name.startswith(name) for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)))


_EXACT = "select count(*) as n, sum(v)::bigint as total, sum(v * (vec_id % 97) * (channel % 7 + 1))::bigint as mix from (select vec_id, unnest(range(0, len(embedding))) as channel, unnest(list_transform(embedding, lambda x: round(x::double * 8192)))::bigint as v from embeddings)"


@query("k02_row_sink", f"select 'stopped' as write, 0 as entries, 0 as n, 0 as total, 0 as mix union all select 'whole', 1, n, total, mix from ({_EXACT})")
def k02(spark, sf):
    """A write that fails on its way leaves nothing, the next one is read back exactly."""
    chunks, path, out = vector_chunks(spark, sf), scratch(spark, "sink"), []
    last = chunks.agg(F.max("first")).first()[0]
    broken = chunks.withColumn("first", F.when((F.col("first") == last) & (F.col("channel") == 0), F.raise_error(F.lit("stopped"))).otherwise(F.col("first")).cast("bigint"))
    sizes = [("emb", table(spark, sf, "embeddings").count(), [r.channel for r in chunks.select("channel").distinct().orderBy("channel").collect()])]
    layout = zarr.sampled_layout(sizes, 64)
    for name, some in (("stopped", broken), ("whole", chunks)):
        try:
            zarr.write_chunks(zarr.as_chunks(some, sizes, 64), path, layout)
            found = _exact(zarr.read(spark, path))
        except PySparkException:
            found = spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "total", "mix")])
        out.append(found.select(F.lit(name).alias("write"), F.lit(left(path)).alias("entries"), "*"))
    return out[0].unionByName(out[1])


@query("k01_backends", f"select unnest(['parquet', 'zarr']) as backend, n, total, mix from ({_EXACT})")
def k01(spark, sf):
    """One recording through either store of the library."""
    chunks, path, flat = vector_chunks(spark, sf), scratch(spark, "backend"), scratch(spark, "backend")
    zarr.write(chunks, path, rows=100)
    job.Job(spark, chunks).write(flat, verify="off")
    both = {"zarr": zarr.read(spark, path), "parquet": spark.read.parquet(flat)}
    rows = [_exact(v).select(F.lit(k).alias("backend"), "*") for k, v in both.items()]
    return rows[0].unionByName(rows[1])


@query("k03_stored_types", f"select t as dtype, recording, count(*) as n, sum(v % m)::bigint as total from {ORDERS}, (select unnest(['int8', 'int16', 'uint16', 'int32', 'int64', 'float64']) as t, unnest([100, 30000, 60000, 1000000, 1000000, 1000000]) as m) group by 1, 2")
def k03_types(spark, sf):
    """Arrays of the source's own number type: whole numbers come back as they went in."""
    parts, orders = [], checkpoint(order_chunks(spark, sf, "bigint"))  # once for all types
    for kind, most in (("int8", 100), ("int16", 30000), ("uint16", 60000), ("int32", 1000000), ("int64", 1000000), ("float64", 1000000)):
        path = scratch(spark, "typed")
        zarr.write(orders.withColumn("values", F.expr(f"transform(values, v -> v % {most})")), path, rows=100, dtype=kind)
        said = zarr.node(f"{path}/r0")["attributes"]["_DTYPE"]
        back = stretches.samples(zarr.read(spark, path, values="double" if kind == "float64" else "bigint"))
        parts.append(back.groupBy("recording").agg(F.count("*").alias("n"), F.sum("value").cast("bigint").alias("total")).select(F.lit(said).alias("dtype"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PLACES = "(select l_suppkey, l_orderkey // 64 as block, count(*) as n from lineitem group by 1, 2)"


@query(
    "o10_block_choice",
    f"""with p as {_PLACES}, e as (select l_suppkey, min(block) as a, max(block) as b from p group by 1),
    i as (select p.l_suppkey, block, row_number() over (partition by p.l_suppkey order by md5('0:' || p.l_suppkey || ':' || block), block) as k from p join e using (l_suppkey) where block > a and block < b)
    select l_suppkey, a as block from e union select l_suppkey, b from e union all select l_suppkey, block from i where k <= 8""",
)
def o10(spark, sf):
    """Blocks of 64 orders' lines of every supplier: the first, the last and eight others."""
    places = table(spark, sf, "lineitem").select("l_suppkey", F.floor(F.col("l_orderkey") / 64).alias("block"))
    return integrity.choose_blocks(places, ["l_suppkey"], "block")


@query(
    "v07_sampled",
    f"""with p as (select recording, block, count(*) as n, max((v % 50 = 7)::int) as bad from {ORDERS} group by 1, 2),
    e as (select recording, min(block) as a, max(block) as b from p group by 1),
    i as (select p.recording, block, row_number() over (partition by p.recording order by md5('0:' || p.recording || ':' || block), block) as k from p join e using (recording) where block > a and block < b),
    c as (select recording, a as block from e union select recording, b from e union all select recording, block from i where k <= 8)
    select recording, count(*) as blocks, sum(n)::bigint as compared, sum(bad)::bigint as differ, (sum(64 * 4))::bigint as bytes from c join p using (recording, block) group by 1""",
)
def v07_sampled(spark, sf):
    """A store whose values of some customers were changed, compared in some blocks of every array; only their files are opened."""
    path = scratch(spark, "sampled")
    orders = checkpoint(order_chunks(spark, sf))  # the job's source is read for the write and for the comparison
    changed = orders.withColumn("values", F.expr("transform(values, v -> if(v % 50 = 7, v + 1, v))"))
    zarr.write(changed, path, rows=64, level=None)
    chosen = checkpoint(integrity.choose_blocks(zarr.blocks(spark, path), ["recording"], "block"))
    source = orders.withColumn("block", F.floor(F.col("first") / 64)).join(chosen, ["recording", "block"], "left_semi")
    states = integrity.compare(job.digests(source), job.digests(zarr.read(spark, path, chosen)), ["recording", "channel", "first"])
    size = zarr.stored_bytes(spark, path, chosen).groupBy("recording").agg(F.sum("bytes").alias("bytes"))
    n = source.groupBy("recording").agg(F.sum(F.size("values")).alias("compared"))
    return states.groupBy("recording").agg(F.count("*").alias("blocks"), F.sum((F.col("state") != "ok").cast("bigint")).alias("differ")).join(n, "recording").join(size, "recording")


@query("x04_observed", f"select recording, count(*) as samples, count(distinct block) as chunks from {ORDERS} group by 1")
def x04(spark, sf):
    """Samples and chunks of a job as they were counted while it wrote and compared."""
    report = job.Job(spark, order_chunks(spark, sf)).write(scratch(spark, "observed"))
    per = report.blocks // max(len(report.recordings), 1)
    rows = [(r, n, -(-n // 64)) for r, n in report.recordings.items()]
    if sum(r[2] for r in rows) != report.blocks:
        raise ValueError(f"{report.blocks} blocks were compared, about {per} a recording")
    return spark.createDataFrame(rows, "recording string, samples bigint, chunks bigint")


@query("x05_cancel", f"select 'cancelled' as run, 0 as entries, 0 as samples union all select 'again', 4, count(*) from {ORDERS}")
def x05(spark, sf):
    """A job that is cancelled while it writes leaves no file; the same job runs through afterwards."""
    from pyspark import InheritableThread

    path, said = scratch(spark, "cancel"), []

    def wait(batches):
        for b in batches:
            time.sleep(3)
            yield b

    chunks = order_chunks(spark, sf)
    slow = job.Job(spark, chunks.mapInArrow(wait, chunks.schema), group=f"cancel-{path[-8:]}")

    def run():
        try:
            slow.write(path)
        except job.Cancelled:
            said.append(0)

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    for _ in range(600):  # until tasks of the write run
        if slow.running():
            break
        time.sleep(0.1)
    slow.cancel()
    thread.join()
    done = [("cancelled", left(path), sum(said))] if said else []
    report = job.Job(spark, chunks).write(path)
    return spark.createDataFrame([*done, ("again", left(path), sum(report.recordings.values()))], "run string, entries int, samples bigint")


@query(
    "s07_request_check",
    """select l_orderkey, l_linenumber, l_extendedprice, case when l_partkey % 900 > l_suppkey % 700 or l_suppkey % 700 > 650 then 'sample range' when l_linenumber > 5 then 'channel' end as refused,
    case when not (l_partkey % 900 > l_suppkey % 700 or l_suppkey % 700 > 650) and l_linenumber <= 5 then l_suppkey % 700 - l_partkey % 900 end as samples from lineitem""",
)
def s07(spark, sf):
    """Requests for a recording of 6 channels and 650 samples, checked before anything is read."""
    asked = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_partkey") % 900).alias("start"), (F.col("l_suppkey") % 700).alias("end"), F.array(F.lit(0), "l_linenumber").alias("channels"))
    return recordings.check_requests(asked, F.lit(6), F.lit(650)).select("l_orderkey", "l_linenumber", "l_extendedprice", "refused", "samples")
