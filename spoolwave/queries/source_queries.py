"""Sources and sinks: tables go out in a binary or text form and are read back by the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoolwave.plans.tables import micros, table
from spoolwave.queries.registry import query
from spoolwave.sources import sidecars
from spoolwave.sources.files import scratch
from spoolwave.sources.recordings import RecordingSource


def _written(spark, sf) -> str:
    """`embeddings` as an EXAMPLE1 recording: parts in sample order, written by the executors."""
    spark.dataSource.register(RecordingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = scratch(spark, "example")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.transform("embedding", lambda v: F.round(v.cast("double") * 8192).cast("float")).alias("values"))
    rows.repartitionByRange("sample").sortWithinPartitions("sample").write.format("recording").option("rate", "25").option("volts_per_bit", "0.25").mode("append").save(path)
    return path


@query("s57_template_source", "select vec_id as sample, (round(embedding[4]::double * 8192)::bigint * 0.25::double)::float as c3, (round(embedding[1]::double * 8192)::bigint * 0.25::double)::float as c0 from embeddings")
def s57(spark, sf):
    rows = spark.read.format("recording").option("channels", "3,0").option("scaled", "true").load(_written(spark, sf))
    return rows.select("sample", F.element_at("values", 1).alias("c3"), F.element_at("values", 2).alias("c0"))


@query("s06_range_scan", "select vec_id as sample, round(list_sum(list_transform(embedding, lambda v: round(v::double * 8192)))) as total from embeddings where vec_id >= 100 and vec_id < 300")
def s06(spark, sf):
    rows = spark.read.format("recording").load(_written(spark, sf)).where("sample >= 100 and sample < 300")
    return rows.select("sample", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double"))).alias("total"))


@query("s32_key_values", "select c_custkey, 'seg' as key, c_mktsegment || '=x' as value from customer")
def s32(spark, sf):
    lines = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("~seg = "), "c_mktsegment", F.lit("=x")).alias("value"))
    return sidecars.key_values(lines)


@query("s51_dash_header", "select c_custkey, 'Name' as key, c_name || ' ' || c_mktsegment as value from customer")
def s51(spark, sf):
    return sidecars.dash_header(table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("-Name   "), "c_name", F.lit(" "), "c_mktsegment").alias("value")))


@query("s60_events_csv", "select event_id, epoch_us(ts) / 1e6 as onset, event_type || ',x' as label from events where event_type <> 'view'")
def s60(spark, sf):
    ev = table(spark, sf, "events")
    line = F.when(F.col("event_type") == "view", F.lit("not a time, x")).otherwise(F.concat((micros("ts") / 1e6).cast("decimal(20,6)").cast("string"), F.lit(" , "), "event_type", F.lit(",x")))
    return sidecars.seconds_labels(ev.select("event_id", line.alias("value")), "event_id")[0]


@query("s24_settings", "select p_partkey, p_name as name, 'S' as type, p_size::varchar as value from part union all select p_partkey, 'price', 'F', p_brand from part")
def s24(spark, sf):
    s = F.concat(F.lit("xNAME="), "p_name", F.lit(";TYPE=S;VALUE="), F.col("p_size").cast("string"), F.lit(";\nNAME=price;TYPE=F;VALUE="), "p_brand", F.lit(";"))
    return sidecars.settings_runs(table(spark, sf, "part").select("p_partkey", s.alias("text")), "text")


@query("s25_text_table", "select s_suppkey, s_suppkey::varchar as id, s_name as name, null::varchar as note from supplier")
def s25(spark, sf):
    lines = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit(" , "), "s_name").alias("value"))
    return sidecars.text_table(lines, ["id", "name", "note"])


@query("s59_checksums", "select page_id, sha1(html) as sha1 from pages")
def s59(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"))
