"""Many small chunks, ranges and texts: tasks and parses follow the work, not the number of pieces."""

import struct

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    """300 chunks of two samples each of two recordings, some never written, one channel without its last value."""
    from spoolwave.sources import zarr

    rows = spark.range(600).where("id % 50 <> 7").select(F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("recording"), F.explode(F.array(F.lit(3), F.lit(9))).alias("channel"), (F.floor(F.col("id") / 2) * 2).alias("first"), "id")
    chunks = rows.select("recording", F.col("channel").cast("int").alias("channel"), "first", F.array((F.col("id") * 2).cast("float"), F.col("channel").cast("float")).alias("values"))
    path = f"file://{tmp_path}/store"
    zarr.write(chunks, path, rows=2)
    return path, chunks


def test_small_chunks_share_tasks(spark, store):
    from spoolwave.sources import zarr

    path, chunks = store
    assert zarr.blocks(spark, path).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    back = zarr.read(spark, path)
    want = {(r.recording, r.channel, r.first): list(r["values"]) for r in chunks.collect()}
    got = {(r.recording, r.channel, r.first): list(r["values"]) for r in back.collect()}
    assert len(got) == back.count() == 2 * 600 and {k: v for k, v in got.items() if k in want} == want
    assert all(v != v for k, values in got.items() if k not in want for v in values)  # never written: the fill value


def test_a_task_lays_out_a_run_of_chunks(spark, store, monkeypatch):
    from spoolwave.sources import zarr

    _, chunks = store
    sizes = [("r0", 600, [3, 9]), ("r1", 600, [3, 9])]
    whole = {(r.array, r.chunk): bytes(r.data) for r in zarr.as_chunks(chunks, sizes, 2).collect()}
    plan = zarr.as_chunks(chunks, sizes, 2)._jdf.queryExecution().toString()
    assert "block" in plan and "run" in plan and len(whole) == chunks.select("recording", "first").distinct().count()
    monkeypatch.setattr(zarr, "BATCH_CHUNKS", 1)  # a group for each chunk, as before
    assert whole == {(r.array, r.chunk): bytes(r.data) for r in zarr.as_chunks(chunks, sizes, 2).collect()}


def test_sizes_of_chosen_chunks(spark, store):
    from spoolwave.sources import zarr

    path, _ = store
    chosen = spark.createDataFrame([("r0", 0), ("r1", 5)], "recording string, block bigint")
    every = {(r.recording, r.block): r.bytes for r in zarr.stored_bytes(spark, path).collect()}
    assert {(r.recording, r.block): r.bytes for r in zarr.stored_bytes(spark, path, chosen).collect()} == {k: every[k] for k in [("r0", 0), ("r1", 5)]}


def test_many_ranges_share_tasks(spark, tmp_path):
    from spoolwave.sources import records

    for name, n in (("a", 5000), ("b", 7), ("c", 0)):
        (tmp_path / f"{name}.rec").write_bytes(b"#" * 5 + b"".join(struct.pack("<id", k, k / 4) for k in range(n)) + b"x")
    df = records.shaped(spark, f"file://{tmp_path}", [("id", "<i4"), ("value", "<f8")], 5, ".rec", split_bytes=12)
    assert 7 < df.rdd.getNumPartitions() <= records.MOST_TASKS + 3
    assert sorted((r.file, r.k, r.id, r.value) for r in df.collect()) == sorted((f, k, k, k / 4) for f, n in (("a.rec", 5000), ("b.rec", 7)) for k in range(n))


def test_settings_are_parsed_once(spark):
    from spoolwave.sources import openephys

    texts = [
        "<SETTINGS><INFO><VERSION>0.<b>6</b>&amp;</VERSION><VERSION>9</VERSION><DATE/></INFO><A><PROCESSOR name='Sources/Rhythm FPGA' nodeId='100'/></A><PROCESSOR NodeId='7' name=' x &lt;y '/><PROCESSOR/></SETTINGS>",
        "<?xml version='1.0' encoding='UTF-8'?><!-- <VERSION>1</VERSION> --><SETTINGS><VERSION><![CDATA[<2>]]><!-- 3 --></VERSION><DATE> d </DATE></SETTINGS>",
        "<VERSION xmlns='urn:a'>1</VERSION>", "<a:X xmlns:a='u'><a:VERSION>1</a:VERSION></a:X>", "<SETTINGS/>", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = openephys.settings_rows(df)
    assert "xpath" not in rows._jdf.queryExecution().toString()
    x = F.col("text")
    said = lambda path: F.when(F.xpath_string(x, F.lit(path)) != "", F.xpath_string(x, F.lit(path)))
    want = df.select("k", said("//DATE").alias("date"), said("//VERSION").alias("version"), F.xpath(x, F.lit("//PROCESSOR/@nodeId | //PROCESSOR/@NodeId")).alias("numbers")).collect()
    got = {r.k: r for r in rows.collect()}
    assert got[0].processors == {"100": "Rhythm_FPGA", "7": "x_<y"}
    for r in want:
        assert (r.date, r.version) == (got[r.k].date, got[r.k].version) and (None if r.numbers is None else sorted(r.numbers)) == (None if got[r.k].processors is None else sorted(got[r.k].processors))
