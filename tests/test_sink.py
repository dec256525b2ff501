"""The transactional store, cancelling, previews, sampled verification and distributed ranks."""

import json
import subprocess
import sys
import textwrap
import threading
import time

import numpy as np
import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from spoolwave.operators import integrity
from spoolwave.operators.ranking import ranked, running_sum
from spoolwave.plans import job
from spoolwave.plans.preview import Previews
from spoolwave.sources import recordings, stretches, zarr

CHUNK = "recording string, channel int, first bigint, values array<float>"


def chunks(spark, n=100, recordings=("a", "b")):
    return spark.createDataFrame([(r, c, at, [float(at + i + c) for i in range(10)]) for r in recordings for c in (0, 2) for at in range(0, n, 10)], CHUNK).repartition(4)


def entries(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir())


def test_store_is_whole_or_absent(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    bad = chunks(spark).withColumn("values", F.when((F.col("first") == 50) & (F.col("channel") == 2), F.raise_error(F.lit("no")).cast("array<float>")).otherwise(F.col("values")))
    sizes = [("a", 100, [0, 2]), ("b", 100, [0, 2])]
    with pytest.raises(Exception):
        zarr.write_chunks(zarr.as_chunks(bad, sizes, 16), path, zarr.sampled_layout(sizes, 16))
    assert entries(tmp_path) == []
    zarr.write(chunks(spark), path, rows=16)
    before = (tmp_path / "s" / "a" / "c" / "0" / "0").read_bytes()
    with pytest.raises(Exception):  # the store that stood there stays
        zarr.write_chunks(zarr.as_chunks(bad, sizes, 16), path, zarr.sampled_layout(sizes, 16), overwrite=True)
    assert entries(tmp_path) == ["s"] and (tmp_path / "s" / "a" / "c" / "0" / "0").read_bytes() == before
    zarr.write(chunks(spark, 50), path, rows=16, overwrite=True)
    assert entries(tmp_path) == ["s"] and not (tmp_path / "s" / "_attempts").exists()
    got = {(r.recording, r.channel, r.sample): r.value for r in stretches.samples(zarr.read(spark, path)).collect()}
    assert len(got) == 200 and all(v == s + c for (_, c, s), v in got.items())


def test_a_lost_attempt_leaves_nothing(tmp_path):
    """One attempt fails after it has written chunks; the next one of the task goes on, and the store is exact."""
    code = f"""
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from spoolwave.sources import stretches, zarr
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", "file://{tmp_path}/ck").getOrCreate()
        sizes = [("a", 400, [0, 1])]
        chunks = spark.createDataFrame([("a", c, at, [float(at + i) for i in range(20)]) for c in (0, 1) for at in range(0, 400, 20)], "{CHUNK}")
        def break_once(batches):
            for n, b in enumerate(batches):
                yield b
            if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                raise RuntimeError("lost")
        rows = zarr.as_chunks(chunks, sizes, 16).repartition(3, "chunk").mapInArrow(break_once, zarr.ROWS)
        zarr.write_chunks(rows, "file://{tmp_path}/s", zarr.sampled_layout(sizes, 16))
        got = {{(r.channel, r.sample): r.value for r in stretches.samples(zarr.read(spark, "file://{tmp_path}/s")).collect()}}
        assert got == {{(c, s): float(s) for c in (0, 1) for s in range(400)}}, len(got)
        print("exact")
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "exact" in done.stdout, done.stderr[-2000:]
    assert entries(tmp_path / "s") == ["a", "zarr.json"] and "writing" not in str(entries(tmp_path))


def test_layout_of_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    layout = zarr.Layout(level=None).group("", recordings=["units"]).group("units/meta", about="x").strings("units/names", ["é", ""], "name").strings("units/title", ["whole"])
    layout.numbers("units/index", [3, 2**63], "uint64", "unit", index=True).numbers("units/rate", [0.5], "float64").stream("units/times", [5, 3], 2, "int16", ["time", "unit"])
    data = np.arange(15, dtype="<i2").reshape(5, 3)
    rows = spark.createDataFrame([("units/times", k, bytearray(np.resize(data[2 * k : 2 * k + 2], (2, 3)).tobytes())) for k in (0, 2)], zarr.ROWS)
    zarr.write_chunks(rows, path, layout)
    read = lambda p: (tmp_path / "s" / p).read_bytes()
    assert read("units/names/c/0") == b"\2\0\0\0\2\0\0\0" + "é".encode() + bytes(4) and read("units/title/c")[8:] == b"whole"
    assert np.frombuffer(read("units/index/c/0"), "<u8").tolist() == [3, 2**63] and np.frombuffer(read("units/rate/c"), "<f8")[0] == 0.5
    meta = zarr.node(f"{path}/units/times")
    assert meta["shape"] == [5, 3] and meta["chunk_grid"]["configuration"]["chunk_shape"] == [2, 3] and meta["fill_value"] == 0 and meta["attributes"]["_DTYPE"] == "int16"
    assert zarr.node(f"{path}/units/index")["attributes"] == {"_DTYPE": "uint64", "_ARRAY_DIMENSIONS": ["unit"], "index": True} and zarr.node(f"{path}/units/meta")["attributes"] == {"about": "x"}
    with pytest.raises(ValueError):
        layout.stream("x", [1], 1, "complex64", ["t"])


def test_stored_types(spark, tmp_path):
    whole = spark.createDataFrame([("r", 0, 0, [1.0, -2.0, 3.0]), ("r", 1, 2, [7.0])], CHUNK)
    path = f"file://{tmp_path}/s"
    zarr.write(whole, path, rows=2, dtype="int16")
    got = {(r.channel, r.sample): r.value for r in stretches.samples(zarr.read(spark, path, values="bigint")).collect()}
    assert got == {(0, 0): 1, (0, 1): -2, (0, 2): 3, (1, 0): 0, (1, 1): 0, (1, 2): 7}
    for odd in (1.5, 40000.0):
        with pytest.raises(Exception, match="int16"):
            zarr.write(spark.createDataFrame([("r", 0, 0, [odd])], CHUNK), f"file://{tmp_path}/t", dtype="int16")
    # a chunk that nothing was written to reads as fill value
    zarr.write(spark.createDataFrame([("r", 0, 10, [1.0])], CHUNK), path, rows=4, overwrite=True)
    assert sum(np.isnan(r.value) for r in stretches.samples(zarr.read(spark, path)).collect()) == 10


def test_reads_only_the_chosen_blocks(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    zarr.write(chunks(spark), path, rows=10)
    for p in (tmp_path / "s" / "a" / "c").iterdir():
        if p.name != "3":
            (p / "0").write_bytes(b"broken")
    only = spark.createDataFrame([("a", 3)], "recording string, block bigint")
    assert sorted(r.first for r in zarr.read(spark, path, only).collect()) == [30, 30]


def test_choice_of_blocks(spark):
    places = spark.createDataFrame([(n, b) for n in (1, 2, 9, 10, 300) for b in range(n)], "array int, block bigint")
    got = {}
    for r in integrity.choose_blocks(places.unionByName(places), ["array"], "block").collect():
        got.setdefault(r.array, []).append(r.block)
    assert {k: len(set(v)) == len(v) for k, v in got.items()} == dict.fromkeys((1, 2, 9, 10, 300), True)
    assert sorted(got[9]) == list(range(9)) and len(got[300]) == 10 and {0, 299} <= set(got[300])
    assert integrity.choose_blocks(places.where("array = 300"), ["array"], "block", seed=1).collect() != got[300]


def test_sampled_job_finds_swapped_blocks(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    source = chunks(spark)
    assert job.Job(spark, source).write(path, verify="sampled").blocks == 40
    swapped = spark.read.parquet(path).withColumn("first", F.when((F.col("recording") == "a") & F.col("first").isin(0, 90), 90 - F.col("first")).otherwise(F.col("first")))
    swapped.write.parquet(f"file://{tmp_path}/bad")
    for level in job.LEVELS[:2]:
        _, n, shown = job.Job(spark, source).verify(f"file://{tmp_path}/bad", source, level)
        assert n == 4 and {s["first"] for s in shown} == {0, 90}
    with pytest.raises(ValueError):
        job.Job(spark, source).write(path, overwrite=True, verify="some")


def test_cancel_leaves_no_file(spark, tmp_path):
    def wait(batches):
        for b in batches:
            time.sleep(2)
            yield b

    source = chunks(spark)
    path = f"file://{tmp_path}/s"
    slow, said = job.Job(spark, source.mapInArrow(wait, source.schema), group="cancel-test"), []

    def run():
        try:
            slow.write(path)
        except job.Cancelled as why:
            said.append(why)

    t = InheritableThread(target=run, session=spark)
    t.start()
    until = time.time() + 60
    while not slow.running() and time.time() < until:
        time.sleep(0.05)
    slow.cancel()
    t.join()
    assert len(said) == 1 and entries(tmp_path) == []
    assert job.Job(spark, source).write(path).ok


def test_failed_job_keeps_the_old_store(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    job.Job(spark, chunks(spark)).write(path)
    before = entries(tmp_path)
    bad = chunks(spark).withColumn("first", F.when(F.col("first") == 90, F.raise_error(F.lit("no"))).otherwise(F.col("first")).cast("bigint"))
    with pytest.raises(Exception):
        job.Job(spark, bad).write(path, overwrite=True)
    assert entries(tmp_path) == before and spark.read.parquet(path).count() == 40
    with pytest.raises(FileExistsError):
        job.Job(spark, chunks(spark)).write(path)
    report = job.Job(spark, chunks(spark, recordings=("c",))).write(path, overwrite=True)
    assert report.recordings == {"c": 200} and json.loads((tmp_path / "s.report.json").read_text())["blocks"] == 20
    assert spark.read.parquet(path).select("recording").distinct().count() == 1


def test_newest_request_wins(spark):
    got, gate = [], threading.Event()
    previews = Previews(spark, lambda key, rows: (got.append((key, rows)), gate.set()))

    def slow(batches):
        for b in batches:
            time.sleep(2)
            yield b

    for key in (1, 2):
        previews.request(key, lambda: spark.range(4, numPartitions=2).mapInArrow(slow, "id long"))
        time.sleep(0.5)
    previews.request(3, lambda: spark.range(5))
    assert gate.wait(60)
    previews.close()
    assert [(k, len(r)) for k, r in got] == [(3, 5)]
    previews.request(4, lambda: spark.range(1).select(F.raise_error(F.lit("bad")).alias("id")))
    previews.threads[-1].join()
    assert got[-1][0] == 4 and isinstance(got[-1][1], Exception)


def test_ranks_over_a_whole_table(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k) if k else None, float(v)) for k, v in zip(rng.integers(0, 5, 2000), rng.integers(0, 30, 2000))] + [(3, 7.0)] * 3000
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = ranked(df, [F.col("k").desc_nulls_last(), F.col("v")]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 5001))
    assert [(r.k, r.v) for r in got] == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    sums = running_sum(df, [F.col("k").asc_nulls_first(), F.col("v")], F.col("k"), "before", ranges=3).orderBy("before", F.col("k").asc_nulls_first(), "v").collect()
    own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted((r.before, r.v) for r in sums) == sorted(zip(np.cumsum([0] + [r[0] or 0 for r in own])[:-1].tolist(), [r[1] for r in own]))
    assert ranked(df.where("k > 9"), [F.col("k")]).count() == 0
    plan = ranked(df, [F.col("k")])._jdf.queryExecution().executedPlan().toString()
    # the one window without a key is over one row a range
    assert plan.count("SinglePartition") == 1 and "Window [sum(_rank_total" in plan


def test_ranks_deal_one_value_over_tasks(spark):
    from spoolwave.operators import ranking

    same = spark.range(20000).select(F.lit(1).alias("k")).repartition(4)
    dealt = same.select("*", F.xxhash64("k").alias("_tie"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(8, "k", "_tie", "_row")
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 6000
    assert ranking.ranked(same, [F.col("k")]).agg(F.sum("rank")).first()[0] == 20000 * 20001 // 2


def test_request_checks(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = [(0, 10, [0, 1]), (5, 4, [0]), (0, 11, [0]), (0, 10, [2]), (0, 10, [-1]), (-1, 3, [0]), (10, 10, []), (0, 5, [None]), (20, 30, [9])]
    df = spark.createDataFrame(rows, "start bigint, end bigint, channels array<int>")
    got = [(r.refused, r.samples) for r in recordings.check_requests(df, F.lit(2), F.lit(10)).collect()]
    assert got == [(None, 10), ("sample range", None), ("sample range", None), ("channel", None), ("channel", None), ("sample range", None), (None, 0), ("channel", None), ("sample range", None)]
    spark.dataSource.register(recordings.RecordingSource)
    (tmp_path / "x.example").write_bytes(recordings.Header(2, 10.0, 1.0).bytes() + np.arange(20, dtype="<i2").tobytes())
    read = lambda **o: spark.read.format("recording").options(**{k: str(v) for k, v in o.items()}).load(f"file://{tmp_path}")
    assert read(start=2, end=10, strict="true").count() == 8
    for options, name in (({"start": 3, "end": 2}, "SampleRange"), ({"end": 11, "strict": "true"}, "SampleRange"), ({"channels": "0,2"}, "NoChannel")):
        with pytest.raises(Exception, match=name):
            read(**options).count()
