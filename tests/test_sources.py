"""Sources read what was written, whole and in parts, and refuse bad requests."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolwave.sources import registry, sidecars, store
from spoolwave.sources.recordings import Header, RecordingSource
from spoolwave.sources.records import FORMATS, write_records


@pytest.fixture()
def example(spark, tmp_path):
    spark.dataSource.register(RecordingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    data = np.random.default_rng(0).integers(-3000, 3000, (500, 5)).astype("<i2")
    (tmp_path / "a.example").write_bytes(Header(5, 100.0, 0.5).bytes() + data[:300].tobytes() + b"x")
    (tmp_path / "b.EXAMPLE").write_bytes(Header(5, 100.0, 0.5).bytes() + data[300:].tobytes())
    (tmp_path / "._a.example").write_bytes(b"junk")
    return f"file://{tmp_path}", data


def load(spark, path, **options):
    rows = spark.read.format("recording").options(**options).load(path).orderBy("sample").collect()
    return [r.sample for r in rows], np.array([r["values"] for r in rows])


def test_conformance(spark, example):
    path, data = example
    n, whole = load(spark, path)
    assert n == list(range(500)) and (whole == data).all()
    _, back = load(spark, path, channels="4,0,2", scaled="true")
    assert np.allclose(back, data[:, [4, 0, 2]] * 0.5)
    n, part = load(spark, path, start="290", end="310")
    assert n == list(range(290, 310)) and (part == data[290:310]).all()
    rows = spark.read.format("recording").load(path).where("sample >= 299 and sample < 302")
    assert sorted(r.sample for r in rows.collect()) == [299, 300, 301] and "Filter (" not in rows._jdf.queryExecution().executedPlan().toString()
    for bad in ({"channels": "5"}, {"start": "9", "end": "3"}, {"layout": "other"}):
        with pytest.raises(Exception):
            load(spark, path, **bad)


def test_interleaved_and_header(spark, tmp_path):
    spark.dataSource.register(RecordingSource)
    data = np.arange(60, dtype="<i2").reshape(20, 3)
    (tmp_path / "run.bin").write_bytes(data.tobytes())
    _, got = load(spark, f"file://{tmp_path}", layout="interleaved", saved="3", channels="2")
    assert (got[:, 0] == data[:, 2]).all()
    with pytest.raises(ValueError):
        Header.parse(b"EXAMPLE2" + bytes(24))
    with pytest.raises(ValueError):
        Header.parse(struct.pack("<8sIddI", b"EXAMPLE1", 0, 1.0, 1.0, 0))


def test_write_and_read(spark, tmp_path):
    spark.dataSource.register(RecordingSource)
    df = spark.range(1000).select(F.col("id").alias("sample"), F.array((F.col("id") % 7).cast("float"), (-F.col("id")).cast("float")).alias("values"))
    path = f"file://{tmp_path}/out"
    df.repartitionByRange(3, "sample").sortWithinPartitions("sample").write.format("recording").option("rate", "10").mode("append").save(path)
    n, got = load(spark, path)
    assert n == list(range(1000)) and (got[:, 1] == -np.arange(1000)).all()


def test_records(spark, tmp_path):
    rng = np.random.default_rng(1)
    for fmt, (suffix, _, fields) in FORMATS.items():
        kind = np.dtype(fields)
        raw = np.frombuffer(rng.integers(1, 120, kind.itemsize * 7).astype(np.uint8).tobytes(), kind)
        uri = f"file://{tmp_path}/{fmt}/x{suffix}"
        write_records(raw, uri, fmt, b"head")
        with open(uri.removeprefix("file://"), "ab") as f:
            f.write(b"partial"[: kind.itemsize - 1])
        reader = registry.builtin()
        assert reader.detect(uri)
        from spoolwave.sources.records import RecordSource

        spark.dataSource.register(RecordSource)
        rows = spark.read.format("records").option("format", fmt).load(uri).orderBy("k").collect()
        assert [r.k for r in rows] == list(range(7))
        for name, *rest in fields:
            for r, x in zip(rows, raw):
                v = x[name]
                if rest[0].startswith("S"):
                    assert r[name] == bytes(v).split(b"\0")[0].decode("latin-1")
                elif len(rest) > 1:
                    assert r[name] == v.tolist()
                else:
                    assert r[name] == v.item() or v != v


def test_registry(spark, example):
    path, data = example
    reg = registry.builtin()
    assert reg.detect(f"{path}/a.example")[0] == ("example", 0.95) and reg.detect(f"{path}/none.txt") == []
    more = reg.with_reader(registry.Reader("mine", RecordingSource, lambda p: 0.95))
    assert [n for n, _ in more.detect(f"{path}/a.example")] == ["example", "mine"]
    assert reg.open(spark, f"{path}/a.example", channels="1").count() == 300
    with pytest.raises(ValueError):
        reg.open(spark, f"{path}/none.txt")


def test_sidecars(spark):
    lines = spark.createDataFrame([(1, "0.5, go"), (2, ""), (3, "bad"), (4, "1.5,a,b")], "n int, value string")
    good, bad = sidecars.seconds_labels(lines, "n")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 0.5, "go"), (4, 1.5, "a,b")] and [r.n for r in bad.collect()] == [3]
    kv = sidecars.key_values(spark.createDataFrame([("~imro=(1)(2=3)",), ("nothing",), ("a=",)], "value string"))
    assert sorted(tuple(r) for r in kv.collect()) == [("a", ""), ("imro", "(1)(2=3)")]
    runs = sidecars.settings_runs(spark.createDataFrame([("xNAME=A;TYPE=S;VALUE=1;\n;NAME=B;TYPE=F;VALUE=;",)], "t string"), "t")
    assert [tuple(r) for r in runs.collect()] == [("A", "S", "1"), ("B", "F", "")]


def test_store(spark, tmp_path):
    df = spark.range(100)
    path = store.write_store(df, "x", F.expr("id div 10"), path=f"file://{tmp_path}/s")
    assert store.read_store(spark, path).count() == 100 and (tmp_path / "s" / "_SUCCESS").exists()
    with pytest.raises(Exception):
        store.write_store(df, "x", path=path)
    store.write_store(spark.range(5), "x", path=path, overwrite=True)
    assert store.read_store(spark, path).count() == 5
