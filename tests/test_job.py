"""The job facade, its report and checks, the command line and the streaming forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolwave.__main__ import main
from spoolwave.operators import edges
from spoolwave.plans import job
from spoolwave.sources import stretches
from spoolwave.streaming import online


@pytest.fixture()
def source(spark, tmp_path):
    data = np.arange(200, dtype="<i2").reshape(100, 2)
    for n in ("EMG1", "Temp", "Skip"):
        (tmp_path / f"{n}.dat").write_bytes(data.tobytes())
    rows = [stretches.stretch(n, f"file://{tmp_path}/{n}.dat", 100, 0, "<i2", 4, [0, 2]) for n in ("EMG1", "Temp", "Skip")]
    return stretches.table(spark, rows)


SPEC = "key string, include boolean, type string, out_name string"


def test_job(spark, source, tmp_path):
    spec = spark.createDataFrame([("Skip", False, None, None), ("EMG1", None, "units", "EMG"), ("Gone", None, None, None)], SPEC)
    path = f"file://{tmp_path}/store"
    r = job.Job(spark, source, spec).write(path)
    assert r.ok and r.recordings == {"EMG": 200, "Temp": 200} and [i["target_name"] for i in r.issues] == ["Gone"]
    assert json.loads((tmp_path / "store.report.json").read_text())["ok"]
    store = spark.read.parquet(path)
    assert job.structural_checks(store).count() == 0
    saved = job.digests(store).cache()
    assert job.recheck(spark, path, saved).where("state <> 'ok'").count() == 0
    with pytest.raises(Exception):
        job.Job(spark, source, spec).write(path)
    # one changed value must be found by the verification
    bad = store.withColumn("values", F.when((F.col("recording") == "EMG") & (F.col("channel") == 1), F.transform("values", lambda v, i: F.when(i == 7, v + 1).otherwise(v))).otherwise(F.col("values")))
    bad.select("channel", "first", "values", "recording").write.partitionBy("recording").parquet(f"file://{tmp_path}/bad")
    found = job.recheck(spark, f"file://{tmp_path}/bad", saved).where("state <> 'ok'").collect()
    assert [(x.recording, x.channel, x.state) for x in found] == [("EMG", 1, "differs")]
    gap = spark.createDataFrame([("r", 0, 0, [1.0, 2.0]), ("r", 0, 5, [1.0])], "recording string, channel int, first bigint, values array<float>")
    assert job.structural_checks(gap).first().message == "samples are missing"
    twice = spark.createDataFrame([("EMG1", None, None, "Temp")], SPEC)
    refused = job.Job(spark, source, twice).write(f"file://{tmp_path}/never")
    assert not refused.ok and not (tmp_path / "never").exists()


def test_verify_reports_every_mismatch(spark, source, tmp_path):
    names = "recording string, channel int, first bigint, values array<float>"
    chunks = spark.createDataFrame([("r", 0, i, [float(i)]) for i in range(160)], names)
    path = f"file://{tmp_path}/bad"
    chunks.withColumn("values", F.when(F.col("first") >= 10, F.array(F.lit(-1.0).cast("float"))).otherwise(F.col("values"))).write.parquet(path)
    counts, n, shown = job.Job(spark, source).verify(path, chunks)
    assert counts == {"r": 160} and n == 150 and [x["first"] for x in shown] == list(range(10, 110))
    assert spark.read.parquet(f"{path}.mismatches").count() == 150
    report = job.Report(path, n_mismatches=n)
    assert not report.ok and json.loads(report.json())["n_mismatches"] == 150


def test_inspect_and_progress(spark, source):
    r = {x.recording: x for x in job.inspect(stretches.read(source), at=10).collect()}
    assert r["Temp"].channels == 2 and r["Temp"].samples == 100 and r["Temp"].head == [20.0, 22.0, 24.0, 26.0, 28.0]
    assert job.Job(spark, source).progress()[0] >= 0


def test_command_line(spark, tmp_path, capsys):
    rec = tmp_path / "in"
    (rec / "continuous" / "A").mkdir(parents=True)
    (rec / "continuous" / "A" / "continuous.dat").write_bytes(np.arange(20, dtype="<i2").tobytes())
    (rec / "structure.oebin").write_text('{"continuous":[{"folder_name":"A","sample_rate":10,"channels":[{"channel_name":"CH1","bit_volts":1,"units":"V"},{"channel_name":"CH2","bit_volts":1,"units":"V"}]}]}')
    assert main(["formats"]) == 0 and "example" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["samples"] == 10
    assert main(["convert", str(tmp_path), f"file://{tmp_path}/out"]) == 0
    assert main(["verify", f"file://{tmp_path}/out"]) == 0
    with pytest.raises(ValueError):
        main(["inspect", str(rec / "continuous")])


def test_streaming_periods_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(10 * i), bool(rng.random() < 0.5)) for i in range(80) for k in range(2)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, up boolean")
    for i in range(4):
        df.where(f"t >= {200 * i} and t < {200 * (i + 1)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = online.line_periods(stream, "k", "t", "up").writeStream.format("memory").queryName("periods").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select k, onset, offset from periods").collect())
    want = sorted(tuple(r) for r in edges.high_periods(df, ["k"], ["t"], "t", "up").where("offset is not null").select("k", "onset", "offset").collect())
    assert got == want


def test_streaming_windows(spark, tmp_path):
    df = spark.createDataFrame([(0, s, float(s % 7)) for s in range(0, 60)] + [(0, s, 1.0) for s in range(200, 230)], "channel int, s int, value double").withColumn("time", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out in (("env", online.envelopes(stream, "time", "10 seconds", "0 seconds")), ("sec", online.gap_sections(stream, "channel", "time", "30 seconds", "0 seconds"))):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select max(hi) from env").first()[0] == 6.0 and spark.sql("select records from sec").first()[0] == 60


def test_zarr_store(spark, source, tmp_path):
    import gzip

    from spoolwave.sources import zarr

    chunks = stretches.read(stretches.split(source, 7))
    path = f"file://{tmp_path}/z"
    catalog = zarr.write(chunks, path, rows=32)
    assert sorted(tuple(r) for r in catalog.collect()) == [(n, 100, 2) for n in ("EMG1", "Skip", "Temp")]
    meta = json.loads((tmp_path / "z" / "Temp" / "zarr.json").read_text())
    assert meta["shape"] == [100, 2] and meta["chunk_grid"]["configuration"]["chunk_shape"] == [32, 2]
    first = np.frombuffer(gzip.decompress((tmp_path / "z" / "Temp" / "c" / "1" / "0").read_bytes()), "<f4").reshape(32, 2)
    assert (first == np.arange(200).reshape(100, 2)[32:64]).all()
    back = {(r.recording, r.channel, r.sample): r.value for r in stretches.samples(zarr.read(spark, path)).collect()}
    assert back == {(r.recording, r.channel, r.sample): r.value for r in stretches.samples(chunks).collect()}
    with pytest.raises(FileExistsError):
        zarr.write(chunks, path)
    assert zarr.write(chunks.where("recording = 'Temp'"), path, overwrite=True).count() == 1 and not (tmp_path / "z" / "Skip").exists()
    assert zarr.chunk_rows(384) == 6510 and zarr.chunk_rows(1, 30000, 1) == 30000


def test_metadata_file(spark, tmp_path):
    from spoolwave.plans import metadata, overlay

    data = {"subject": {"id": "r1", "age": "P90D", "strain": ""}, "streams": {"*": {"include": True}, "Skip": {"include": False}}, "session": {"lab": None}}
    path = f"file://{tmp_path}/m.json"
    metadata.write(data, path)
    back = metadata.read(path)
    assert back == {"subject": {"id": "r1", "age": "P90D"}, "streams": {"*": {"include": True}, "Skip": {"include": False}}}
    assert metadata.subject(back, {"species": "rat", "id": "old"}) == {"species": "rat", "id": "r1", "age": "P90D", "sex": "U", "age_reference": "birth"}
    for bad in ({"other": {}}, {"streams": {"x": {"inclde": True}}}, {"subject": {"sex": "x"}}):
        with pytest.raises(ValueError):
            metadata.check(bad)
    rec = spark.createDataFrame([("EMG",), ("Skip",)], "name string")
    assert [r.name for r in overlay.resolve(rec, metadata.spec(spark, back))[0].collect()] == ["EMG"]


def test_validate_and_recheck_by_command(spark, tmp_path, capsys):
    rec = tmp_path / "in"
    (rec / "continuous" / "A").mkdir(parents=True)
    (rec / "continuous" / "A" / "continuous.dat").write_bytes(np.arange(20, dtype="<i2").tobytes())
    (rec / "structure.oebin").write_text('{"continuous":[{"folder_name":"A","sample_rate":10,"channels":[{"channel_name":"CH1","bit_volts":1,"units":"V"},{"channel_name":"CH2","bit_volts":1,"units":"V"}]}]}')
    meta = tmp_path / "meta.json"
    meta.write_text('{"streams": {"Gone": {"include": true}, "A": {"out_name": "B"}}}')
    said = lambda: json.loads(capsys.readouterr().out)
    assert main(["validate", str(tmp_path)]) == 0 and said()["findings"] == 0
    main(["validate", str(tmp_path), "--meta", str(meta)])
    assert [f["target_name"] for f in said()["first"]] == ["Gone"]
    out = f"file://{tmp_path}/out"
    assert main(["convert", str(tmp_path), out, "--meta", str(meta), "--verify", "sampled"]) == 0 and not (tmp_path / "out.digests").exists()
    assert main(["convert", str(tmp_path), out, "--meta", str(meta), "--overwrite"]) == 0 and (tmp_path / "out.digests").exists()
    capsys.readouterr()
    assert main(["verify", out]) == 0 and said()["findings"] == 0
    broken = spark.read.parquet(out).withColumn("values", F.transform("values", lambda v: v + (F.col("channel") == 1).cast("int"))).collect()
    spark.createDataFrame(broken, "channel int, first bigint, values array<float>, recording string").write.mode("overwrite").partitionBy("recording").parquet(out)
    assert main(["verify", out]) == 1
    found = said()
    assert found["by_level"] == {"error": 1} and found["first"][0]["message"] == "block differs" and found["first"][0]["target_name"] == "B:1:0"
