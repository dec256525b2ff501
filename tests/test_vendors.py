"""Vendor layouts from bytes made in the tests."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolwave.sources import blackrock, intan, neuralynx, openephys, spikeglx, stretches, tdt
from spoolwave.sources.records import write_records


def values(chunks):
    out = {}
    for r in chunks.collect():
        out.setdefault((r.recording, r.channel), {}).update({r.first + i: v for i, v in enumerate(r["values"])})
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_stretches(spark, tmp_path, monkeypatch):
    data = np.arange(300, dtype="<i2").reshape(100, 3)
    (tmp_path / "x.dat").write_bytes(b"head" + data.tobytes())
    s = stretches.table(spark, [stretches.stretch("r", f"file://{tmp_path}/x.dat", 100, 4, "<i2", 6, [0, 2, 4], None, [1.0, 2.0, 1.0], [0.0, 0.0, -5.0])])
    got = values(stretches.read(s))
    assert got["r", 0] == data[:, 0].tolist() and got["r", 1] == (data[:, 1] * 2).tolist() and got["r", 2] == (data[:, 2] - 5.0).tolist()
    part = stretches.wanted(s, 10, 25, channels=[2])
    assert values(stretches.read(part, scaled=False)) == {("r", 2): data[10:25, 2].tolist()}
    assert stretches.wanted(s, only=["q"]).count() == 0
    small = stretches.split(s, 7)
    assert small.count() == 15 and sorted(r.samples for r in small.collect())[0] == 2
    assert stretches.samples(stretches.read(s)).count() == 300


def test_tdt_block(spark, tmp_path):
    kind = np.dtype([("size", "<i4"), ("type", "<i4"), ("name", "S4"), ("chan", "<u2"), ("sortcode", "<u2"), ("timestamp", "<f8"), ("offset", "<u8"), ("format", "<i4"), ("freq", "<f4")])
    tev = np.arange(64, dtype="<i2").tobytes() + np.arange(4, dtype="<f4").tobytes()
    rows = [(0, 0, b"", 0, 0, 0, 0, 0, 0), (10, 0x8801, b"\1", 0, 0, 100.0, 0, 0, 0)]
    for k, (chan, off) in enumerate(((1, 0), (2, 32), (1, 64), (2, 96), (1, 0))):  # channel 1 has a packet more
        rows.append((10 + 8, 0x8101, b"Wav1", chan, 0, 100.0 + k, off, 2, 1000.0))
    rows += [(10 + 4, 0x8201, b"eNe1", 1, 3, 101.0, 128, 0, 1000.0), (10 + 4, 0x8201, b"eNe1", 1, 3, 101.0, 10**6, 0, 1000.0)]
    write_records(np.array(rows, kind), f"file://{tmp_path}/blk/b.tsq", "tsq")
    (tmp_path / "blk" / "b.tev").write_bytes(tev)
    assert [b.rsplit("/", 1)[-1] for b in tdt.blocks(f"file://{tmp_path}")] == ["blk"]
    idx = tdt.index(spark, f"file://{tmp_path}/blk/b.tsq").cache()
    got = values(stretches.read(tdt.streams(idx, f"file://{tmp_path}/blk/b.tev")))
    assert got == {("Wav1", 1): [*range(16), *range(32, 48)], ("Wav1", 2): [*range(16, 32), *range(48, 64)]}
    (tmp_path / "s.SortResult").write_bytes(bytes(1024) + bytes([0] * 6 + [9, 9]))
    sn = tdt.snips(idx, f"file://{tmp_path}/blk/b.tev", len(tev), tdt.sort_result(spark, f"file://{tmp_path}/s.SortResult"))
    w = stretches.payloads(sn, ["store", "sort_code"]).collect()
    assert len(w) == 1 and w[0].waveform == [0.0, 1.0, 2.0, 3.0] and w[0].sort_code == 9


def test_tdt_sev(spark, tmp_path):
    def sev(fmt, channel):
        return struct.pack("<Q3sB4sHHHHBBH", 0, b"SEV", 3, b"Raw1", channel, 2, 4, 0, fmt, 1, 12) + bytes(40 - 28)

    for c in (1, 2):
        for h in (0, 1):
            (tmp_path / f"t_b_Raw1_Ch{c}{'-1h' if h else ''}.sev").write_bytes(sev(2, c) + np.arange(h * 10, h * 10 + 10, dtype="<i2").tobytes())
    s, catalog = tdt.sev_stretches(spark, f"file://{tmp_path}", {"Raw1": 24414.0625})
    assert values(stretches.read(s)) == {("Raw1", 1): list(range(20)), ("Raw1", 2): list(range(20))}
    assert [tuple(r) for r in catalog.collect()] == [("Raw1", 24414.0625, 2)]
    assert tdt.sev_name("t_b_Raw1_Ch12-3h") == ("Raw1", 12, 3) and tdt.sev_header(bytes(40))["rate"] == 24414.0625
    (tmp_path / "t_b_Raw1_Ch3.sev").write_bytes(sev(0, 3) + bytes(8))
    with pytest.raises(ValueError):
        tdt.sev_stretches(spark, f"file://{tmp_path}")


def test_tdt_text():
    fields, notes = tdt.synapse_notes('Experiment: E1\nStart: 10:00:00am 01/01/2020\n\nNote-1: 10:00:05am [Bottle] "In"\nNote-2: 10:01:00am "two\nlines"\nStop: 11:00:00am\n')
    assert fields["Experiment"] == "E1" and notes == [("10:00:05am", "Bottle", "In"), ("10:01:00am", "", "two\nlines")]
    assert tdt.store_listing("Object ID : RZ2(1) - Processor\n Store ID : Wav1\n Source : Amp")["Wav1"] == {"object": "RZ2(1)", "type": "Processor"}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("Summary.txt", "[Session]\nName=abc\nOther=NONE\n")
    assert tdt.tin_summary(buf.getvalue()) == {"Session.Name": "abc"} and tdt.tnt_notes("v1\n a \n\nb") == ["a", "b"]
    assert tdt.gap_log("recording started at sample: 7\ngap detected. last saved sample: 10, new saved sample: 20") == (7, [(10, 20)])
    assert tdt.software_version(True, False, "95") == "Synapse 95" and tdt.software_version(False, True, None) == "OpenEx"


def test_spikeglx(spark, tmp_path):
    d = tmp_path / "run_g0"
    d.mkdir()
    data = np.arange(40, dtype="<i2").reshape(10, 4)
    for t in ("0", "cat", "10"):
        base = d / f"run_g0_t{t}.imec0.ap"
        base.with_name(base.name + ".bin").write_bytes(data.tobytes())
        base.with_name(base.name + ".meta").write_text("nSavedChans=4\ntypeThis=imec\nimAiRangeMax=0.6\nsnsSaveChanSubset=0:2,384\nsnsApLfSy=3,0,1\n~imroTbl=(0,4)(0 0 0 500 250)(1 0 0 500 250)(2 0 0 1000 250)(3 0 0 1 1)\n")
    found = spikeglx.runs(f"file://{tmp_path}")
    assert list(found) == ["run_g0"] and [n.trigger for n, _ in found["run_g0"]] == ["0", "10", "cat"]
    got = values(stretches.read(spikeglx.run_stretches(spark, f"file://{tmp_path}")))
    vpb = 0.6 / 512
    assert np.allclose(got["run_g0_t0.imec0.ap", 2], data[:, 2] * vpb / 1000) and got["run_g0_t0.imec0.ap", 384] == data[:, 3].tolist()
    assert spikeglx.parse_name("a.b_g1_t3.obx0.obx.meta") == spikeglx.Name("a.b_g1", "3", "obx0", None) and spikeglx.parse_name("x_t0.imec.lf.meta").stream == "imec0" and spikeglx.parse_name("x.bin") is None
    assert spikeglx.sites({"snsGeomMap": "(NP1010,1,0,70)(0:27:0:1)(0:59:20:1)"}) == [(0, 27.0, 0.0), (0, 59.0, 20.0)]
    with pytest.raises(ValueError):
        (tmp_path / "bad.meta").write_text("a=b")
        spikeglx.meta(f"file://{tmp_path}/bad.meta")


def qs(s):
    return struct.pack("<I", len(s) * 2) + s.encode("utf-16-le")


def intan_header(n_amp=2, n_adc=1):
    h = struct.pack("<Ihhf", intan.RHD, 1, 3, 20000.0) + struct.pack("<hff", 1, 1.0, 0.1) + struct.pack("<f", 7500.0) + struct.pack("<3f", 1, 1, 1) + struct.pack("<hff", 0, 1, 1)
    h += qs("note") + qs("") + qs("") + struct.pack("<h", 1) + struct.pack("<h", 1) + struct.pack("<h", 1) + qs("Port A") + qs("A") + struct.pack("<hhh", 1, n_amp + n_adc, n_amp)
    for i in range(n_amp + n_adc):
        h += qs(f"A-{i:03d}") + qs(f"c{i}") + struct.pack("<5h", i, i, 0 if i < n_amp else 3, 1, 0) + struct.pack("<h", 0) + struct.pack("<4h", 0, 0, 0, 0) + struct.pack("<ff", 1e5, 0.0)
    return h


def test_intan(spark, tmp_path):
    head = intan_header()
    rng = np.random.default_rng(0)
    amp, adc = rng.integers(0, 65536, (2, 120)), rng.integers(0, 65536, (1, 120))
    body = b""
    for k in range(2):
        s = slice(60 * k, 60 * k + 60)
        body += np.arange(60 * k, 60 * k + 60, dtype="<i4").tobytes() + amp[:, s].astype("<u2").tobytes() + np.array([2500], "<u2").tobytes() + adc[:, s].astype("<u2").tobytes()
    (tmp_path / "x.rhd").write_bytes(head + body + b"12")
    st, h = intan.traditional_stretches(spark, f"file://{tmp_path}/x.rhd")
    assert h.version == (1, 3) and h.block == 60 and h.temp_sensors == 1 and h.notes == ["note"] and [c["name"] for c in h.channels] == ["c0", "c1", "c2"] and h.size == len(head)
    got = values(stretches.read(st))
    assert np.allclose(got["amplifier", 1], (amp[1] - 32768) * 0.195e-6, rtol=1e-5) and np.allclose(got["adc", 0], (adc[0] - 32768) * 152.59e-6, rtol=1e-5) and np.allclose(got["temperature", 0], [25.0, 25.0])
    (tmp_path / "amplifier.dat").write_bytes(amp.T.astype("<u2").tobytes())
    got = values(stretches.read(intan.per_type_stretches(spark, f"file://{tmp_path}", h)))
    assert np.allclose(got["amplifier", 0], amp[0].astype("<u2").view("<i2") * 0.195e-6, rtol=1e-5)
    (tmp_path / "amp-A-001.dat").write_bytes(amp[1].astype("<u2").tobytes())
    st, missing = intan.per_channel_stretches(spark, f"file://{tmp_path}", h)
    assert list(values(stretches.read(st))) == [("amplifier", 1)] and "amp-A-000.dat" in missing
    with pytest.raises(ValueError):
        intan.parse(head[:40])


def nsx_bytes(blocks, wide=False, resolution=30000):
    head = 314 + 66 * 2
    h = b"NEURALCD" + bytes([3 if wide else 2, 0 if wide else 3]) + struct.pack("<I", head) + b"lab".ljust(16, b"\0") + bytes(256) + struct.pack("<II", 30, resolution) + struct.pack("<8H", *[2020, 1, 0, 1, 0, 0, 0, 0]) + struct.pack("<I", 2)
    for i in range(2):
        h += b"CC" + struct.pack("<H", i + 1) + f"e{i}".encode().ljust(16, b"\0") + b"\1\1" + struct.pack("<4h", -1000, 1000, -250, 250) + b"uV".ljust(16, b"\0") + bytes(20)
    return h + b"".join(struct.pack("<BQI" if wide else "<BII", 1, ts, len(d)) + d.astype("<i2").tobytes() for ts, d in blocks)


def test_blackrock(spark, tmp_path):
    d = np.arange(40).reshape(20, 2)
    (tmp_path / "a.ns3").write_bytes(nsx_bytes([(0, d[:8]), (5000, d[8:9]), (9000, d[9:])])[:-4])
    st, h = blackrock.nsx_stretches(spark, f"file://{tmp_path}/a.ns3", "a")
    assert h.rate == 1000.0 and [p[:2] for p in h.parts] == [(0, 8), (5000, 1), (9000, 10)] and len(h.warnings) == 1 and h.channels[0]["front_end"]
    got = values(stretches.read(st))
    assert np.allclose(got["a.p1", 1], d[:8, 1] * 0.25e-6) and np.allclose(got["a.p2", 0], d[9:19, 0] * 0.25e-6) and list(sorted({k[0] for k in got})) == ["a.p1", "a.p2"]
    ms = 1_000_000
    (tmp_path / "p.ns3").write_bytes(nsx_bytes([(t * ms, d[i : i + 1]) for i, t in enumerate((5, 6, 7, 20, 21))], True, 10**9))
    assert [p[:2] for p in blackrock.nsx(f"file://{tmp_path}/p.ns3").parts] == [(5 * ms, 3), (20 * ms, 2)]
    size = 8 + 2 * 4
    ext = b"NEUEVWAV" + struct.pack("<HBBH", 1, 1, 1, 250) + bytes(7) + bytes([2]) + struct.pack("<H", 4) + bytes(8)
    ext += b"NEUEVLBL" + struct.pack("<H", 1) + b"unit".ljust(22, b"\0")
    head = 336 + len(ext)
    raw = b"NEURALEV" + bytes([2, 3]) + struct.pack("<HIIII", 1, head, size, 30000, 30000) + bytes(332 - 28) + struct.pack("<I", 2) + ext
    pk = [struct.pack("<IHBB4h", t, i, r, 0, *w) for t, i, r, w in ((10, 1, 5, (1, 2, 3, 4)), (20, 0, 1, (7, 0, 0, 0)), (30, 3000, 0, (0,) * 4), (40, 0, 129, (9, 0, 0, 0)))]
    (tmp_path / "a.nev").write_bytes(raw + b"".join(pk))
    n = blackrock.nev(f"file://{tmp_path}/a.nev")
    assert n.labels == {1: "unit"} and n.waves == {1: (250, 2, 4)} and n.packet_bytes == size
    rows = blackrock.packets(spark, f"file://{tmp_path}/a.nev", n).cache()
    assert sorted((r.ticks, r.id) for r in rows.collect()) == [(10, 1), (20, 0), (40, 0)]
    assert sorted((r.kind, r.value) for r in blackrock.digital_words(rows, "2.3").collect()) == [("digital", 7), ("serial", 9)]
    sp = blackrock.spikes(spark, rows, f"file://{tmp_path}/a.nev", n)
    w = stretches.payloads(sp, ["store", "channel", "sort_code"], scale="scale").collect()
    assert len(w) == 1 and (w[0].store, w[0].sort_code) == ("spikes", 5) and np.allclose(w[0].waveform, np.array([1, 2, 3, 4]) * 250e-9)
    assert {k.rsplit("/", 1)[-1]: len(v) for k, v in blackrock.file_sets(f"file://{tmp_path}").items()} == {"a": 2, "p": 1}


def test_openephys(spark, tmp_path):
    rec = tmp_path / "exp" / "recording1"
    (rec / "continuous" / "A").mkdir(parents=True)
    data = np.arange(20, dtype="<i2").reshape(10, 2)
    (rec / "continuous" / "A" / "continuous.dat").write_bytes(data.tobytes())
    (rec / "structure.oebin").write_text('{"continuous":[{"folder_name":"A/","sample_rate":30000,"channels":[{"channel_name":"CH1","bit_volts":0.195},{"channel_name":"P_SYNC","bit_volts":3}]},{"folder_name":"gone","channels":[]}]}')
    assert [w.rsplit("/", 1)[-1] for w in openephys.walk(f"file://{tmp_path}", "structure.oebin")] == ["recording1"] and openephys.walk(f"file://{tmp_path}", "structure.oebin", 1) == []
    got = values(stretches.read(openephys.binary_stretches(spark, f"file://{rec}")))
    assert np.allclose(got["A", 0], data[:, 0] * 0.195e-6) and got["A", 1] == data[:, 1].tolist()
    buf = io.BytesIO()
    np.save(buf, np.array([1, -2], "<i8"))
    assert openephys.npy(buf.getvalue()).tolist() == [1, -2]
    with pytest.raises(ValueError):
        buf = io.BytesIO()
        np.save(buf, np.array([1], ">i4"))
        openephys.npy(buf.getvalue())
    kind = np.dtype([("timestamp", "<i8"), ("n", "<u2"), ("recording", "<u2"), ("samples", ">i2", 1024), ("marker", "S10")])
    for name, firsts in (("100_CH1", (1024, 2048, 4096)), ("100_CH2", (0, 1024, 2048, 4096))):
        r = np.zeros(len(firsts), kind)
        r["timestamp"], r["n"] = firsts, 1024
        r["samples"] = np.array(firsts)[:, None] // 1024
        write_records(r, f"file://{tmp_path}/legacy/{name}.continuous", "oe_continuous")
    from spoolwave.sources.records import RecordSource

    spark.dataSource.register(RecordSource)
    recs = spark.read.format("records").option("format", "oe_continuous").load(f"file://{tmp_path}/legacy")
    out = {r.file: sorted(((x.sample, x.value) for x in openephys.legacy_samples(recs).where(f"file = '{r.file}'").collect())) for r in recs.select("file").distinct().collect()}
    assert all(len(v) == 4096 and v[0][0] == 1024 for v in out.values())
    one = dict(out["100_CH1.continuous"])
    assert one[1024] == 1 and one[3071] == 2 and one[3072] == 0 and one[4096] == 4
    assert openephys.legacy_name("100_CH3.continuous") == ("100", None, "CH3", 1) and openephys.legacy_name("100_RhythmData-A_CH3_2.continuous") == ("100", "RhythmData-A", "CH3", 2) and openephys.legacy_name("x.continuous") is None
    spike = np.zeros(2, np.dtype([("head", "V42"), ("wave", "<u2", (2, 3)), ("gain", "<f4", (2,)), ("threshold", "<u2", (2,)), ("recording", "<u2")]))
    spike["wave"], spike["gain"] = 32768 + 10, (1000.0, 0.0)
    (tmp_path / "SE0.spikes").write_bytes(bytes(1024) + spike.tobytes())
    found = openephys.legacy_spikes(spark, f"file://{tmp_path}/SE0.spikes", 2, 3, split_bytes=1)
    w = {(r.k, r.channel): r.waveform for r in found.collect()}
    assert found.rdd.getNumPartitions() == 2  # a task for each range of records
    assert np.allclose(w[0, 0], 10e-6) and w[1, 1] == [0.0] * 3
    xml = "<SETTINGS><INFO><VERSION>0.6</VERSION><DATE>30 Aug 2023 23:41:36</DATE></INFO><PROCESSOR name='Sources/Rhythm FPGA' nodeId='100'/><ELECTRODE_XPOS CH0='1'/><ELECTRODE_YPOS CH0='2'/></SETTINGS>"
    assert openephys.settings(xml) == {"date": "30 Aug 2023 23:41:36", "version": "0.6", "sites": {"CH0": (1.0, 2.0)}} and openephys.processor_names(xml) == {"100": "Rhythm_FPGA"}
    assert openephys.settings_name(1) == "settings.xml" and openephys.settings_name(3) == "settings_3.xml" and openephys.software_time("Software Time (milliseconds since midnight Jan 1st 1970 UTC): 12@x") == 12


def test_neuralynx(spark, tmp_path):
    kind = np.dtype([("timestamp", "<u8"), ("channel", "<u4"), ("rate", "<u4"), ("valid", "<u4"), ("samples", "<i2", 512)])
    r = np.zeros(3, kind)
    r["timestamp"], r["valid"], r["rate"] = (1000000, 1512000, 3024000), 512, 1000
    r["samples"] = np.arange(3)[:, None]
    head = b"######## header\r\n-ADBitVolts 0.5\r\n-SamplingFrequency 1000\r\n-InputInverted True\r\n-ADBitVolts 9\r\n-TimeCreated 2019/02/03 10:11:12\r\n"
    write_records(r, f"file://{tmp_path}/CSC1.ncs", "ncs", head)
    h = neuralynx.header((tmp_path / "CSC1.ncs").read_bytes())
    assert neuralynx.volts_per_bit(h, 2) == [-0.5, -0.5] and neuralynx.opened(h) == ("2019-02-03", "10:11:12") and neuralynx.acquisition(h) == "measured" and neuralynx.application(h) is None
    rec = neuralynx.ncs(spark, f"file://{tmp_path}")
    s = sorted(tuple(x) for x in neuralynx.ncs_sections(rec, 1000.0).select("section", "first", "last", "start", "samples").collect())
    assert s == [(0, 0, 1, 1000000, 1024), (1, 2, 2, 3024000, 512)]
    whole = r.copy()
    whole["timestamp"], whole["valid"] = (1000000, 1500000, 2024000), (512, 512, 100)
    write_records(whole, f"file://{tmp_path}/w/CSC2.ncs", "ncs", head)
    assert [tuple(x) for x in neuralynx.ncs_sections(neuralynx.ncs(spark, f"file://{tmp_path}/w"), 1000.0).select("section", "last", "samples").collect()] == [(0, 2, 1124)]
    v = sorted((x.sample, x.value) for x in neuralynx.ncs_samples(neuralynx.ncs(spark, f"file://{tmp_path}/w"), 0.5).collect())
    assert len(v) == 1124 and v[-1] == (1123, 1.0)
    sp = np.zeros(2, np.dtype([("timestamp", "<u8"), ("entity", "<u4"), ("cell", "<u4"), ("features", "<u4", (8,)), ("data", "<i2", (4, 2))]))
    sp["data"] = np.arange(8).reshape(4, 2)
    (tmp_path / "x.nst").write_bytes(bytes(16384) + sp.tobytes())
    w = {(x.k, x.wire): x.waveform for x in neuralynx.spikes(spark, f"file://{tmp_path}/x.nst", 2, 4, [1.0, 2.0]).collect()}
    assert w[0, 0] == [0.0, 2.0, 4.0, 6.0] and w[1, 1] == [2.0, 6.0, 10.0, 14.0]


def test_shaped_records(spark, tmp_path):
    from spoolwave.sources.records import shaped

    fields = [("head", "V3"), ("id", "<u4"), ("tag", "S4"), ("grid", ">i2", (2, 3)), ("line", "<f4", (2,)), ("byte", "u1")]
    r = np.zeros(50, np.dtype(fields))
    r["id"], r["tag"], r["byte"] = np.arange(50), [f"t{i}".encode() for i in range(50)], 255
    r["grid"], r["line"] = np.arange(300).reshape(50, 2, 3) - 5, np.arange(100).reshape(50, 2) / 2
    for name in ("a", "b"):
        (tmp_path / f"{name}.rec").write_bytes(bytes(7) + r.tobytes() + b"part")
    df = shaped(spark, f"file://{tmp_path}", fields, 7, ".rec", split_bytes=200)
    assert df.rdd.getNumPartitions() > 10 and df.columns == ["file", "k", "id", "tag", "grid", "line", "byte"]
    got = {(x.file, x.k): x for x in df.collect()}
    assert len(got) == 100 and got["b.rec", 49].grid == (np.arange(294, 300).reshape(2, 3) - 5).tolist() and got["a.rec", 3].line == [3.0, 3.5] and got["a.rec", 3].byte == 255 and got["a.rec", 3].tag == "t3"
    few = shaped(spark, f"file://{tmp_path}/a.rec", fields, 7, columns=["grid"])
    assert few.columns == ["file", "k", "grid"] and few.count() == 50
    for bad in ({"columns": ["none"]}, {"columns": ["head"]}):
        with pytest.raises(Exception, match="none|head"):
            shaped(spark, f"file://{tmp_path}", fields, 7, ".rec", **bad).count()
    assert shaped(spark, f"file://{tmp_path}", fields, 7, ".other").count() == 0


def test_locate_in_records(spark):
    block = 8
    firsts = {"a": [0, 8, 16, 40, 48, 1000], "b": [3, 11, 100], "over": [0, 4]}
    records = spark.createDataFrame([(f, k, t) for f, v in firsts.items() for k, t in enumerate(v)], "file string, k bigint, timestamp bigint")
    asked = [(f, s) for f in (*firsts, "none") for s in (-1, 0, 3, 5, 7, 8, 10, 18, 19, 23, 24, 39, 40, 55, 56, 107, 108, 999, 1000, 1007, 1008)] + [("a", 5)] * 2 + [(None, 5)]
    got = openephys.locate(spark.createDataFrame(asked, "file string, sample bigint"), records, block).collect()
    want = []
    for f, s in asked:
        k = max((k for k, t in enumerate(firsts.get(f, [])) if t <= s), default=None)
        inside = k is not None and s - firsts[f][k] < block
        want.append((f, s, k if inside else None, s - firsts[f][k] if inside else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_long_gap_is_a_row(spark):
    far = 10**9
    records = spark.createDataFrame([("f", k, t, [k + 1] * 1024) for k, t in enumerate((0, 1024, far))], "file string, k bigint, timestamp bigint, samples array<smallint>")
    runs = sorted((r.first, r.n, r.samples is None) for r in openephys.legacy_runs(records).collect())
    assert runs == [(0, 1024, False), (1024, 1024, False), (2048, far - 2048, True), (far, 1024, False)]
    got = sorted((r.sample, r.value) for r in openephys.legacy_samples(records, start=far - 3, end=far + 2).collect())
    assert got == [(far - 3, 0.0), (far - 2, 0.0), (far - 1, 0.0), (far, 3.0), (far + 1, 3.0)]
    pieces = openephys.legacy_chunks(records, 2000, 300_000)
    assert pieces.agg(F.max(F.size("values"))).first()[0] == 65536 and openephys.legacy_samples(records, start=2000, end=300_000).count() == 298_000


def test_sidecars_of_many_sessions(spark):
    texts = [
        '{"continuous": [{"folder_name": "A/", "sample_rate": 30000, "channels": [{"channel_name": "CH1", "bit_volts": 0.5, "units": "uV"}, {"channel_name": "x_SYNC", "bit_volts": 3, "units": "V"}, {"channel_name": "ADC1", "units": "V", "bit_volts": 2}]}, {"folder_name": "B", "stream_name": "s"}]}',
        '{"continuous": []}', "{}", "broken", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {(r.k, r.folder): r for r in openephys.structures(df).collect()}
    assert set(got) == {(0, "A"), (0, "B")} and got[0, "A"].stream == "A" and got[0, "B"].stream == "s" and got[0, "B"].channels == []
    want = openephys.structure(texts[0])[0]
    assert [c.asDict() for c in got[0, "A"].channels] == want["channels"] and got[0, "A"].rate == want["rate"]
    xml = "<SETTINGS><INFO><VERSION>0.6</VERSION><DATE>30 Aug 2023 23:41:36</DATE></INFO><PROCESSOR name='Sources/Rhythm FPGA' nodeId='100'/><ELECTRODE_XPOS CH0='1' CH1=\"3.5\"/><ELECTRODE_YPOS CH0='2'/></SETTINGS>"
    rows = openephys.settings_rows(spark.createDataFrame([(1, xml), (2, "<SETTINGS/>"), (3, None)], "k int, text string")).collect()
    one = next(r for r in rows if r.k == 1)
    said = openephys.settings(xml)
    assert (one.date, one.version, one.processors) == (said["date"], said["version"], openephys.processor_names(xml)) and {k: (v.x, v.y) for k, v in one.sites.items()} == said["sites"]
    assert all(r.version is None and not r.processors and not r.sites for r in rows if r.k != 1)


def test_metadata_of_many_files(spark):
    from spoolwave.plans import metadata

    texts = ['{"subject": {"id": "a", "sex": "M"}}', '{"extra": 1, "subject": {"colour": 1, "sex": "X"}}', "[1]", None, '{"groups": [{"name": "g", "bad": 1}], "streams": {"a": {"gain": 1}, "b": {}}, "session": {"lab": "l"}}', "{}"]
    got = sorted((r.k, r.fault) for r in metadata.faults(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).collect())
    assert got == [(1, "subject.sex"), (1, "unknown key extra"), (1, "unknown key subject.colour"), (2, "no metadata"), (3, "no metadata"), (4, "unknown key groups.bad"), (4, "unknown key streams.gain")]
    for k, t in enumerate(texts):
        if t and t.startswith("{"):
            if any(x[0] == k for x in got):
                with pytest.raises(ValueError):
                    metadata.check(json.loads(t))
            else:
                metadata.check(json.loads(t))
    stated = spark.createDataFrame([(1, "s", "", None), (2, None, None, "P1D")], "k int, id string, species string, age string")
    recorded = spark.createDataFrame([(1, "old", "rat"), (3, None, None), (4, "only", None)], "k int, id string, species string")
    found = {}
    for r in metadata.subjects(stated, recorded, "k").collect():
        found.setdefault(r.k, {})[r.field] = r.value
    assert found == {1: {"id": "s", "species": "rat", "sex": "U"}, 2: {"age": "P1D", "age_reference": "birth", "sex": "U"}, 4: {"id": "only", "sex": "U"}}
    assert found[1] == metadata.subject({"subject": {"id": "s", "species": ""}}, {"id": "old", "species": "rat"})
