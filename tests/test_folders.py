"""Every folder format through detection, session, conformance kit and command line."""

import json
import struct

import numpy as np
import pytest
from test_vendors import intan_header, nsx_bytes

from spoolwave.__main__ import main
from spoolwave.sources import folders, stretches
from spoolwave.sources.records import FORMATS, write_records


def tdt(path):
    kind = np.dtype(FORMATS["tsq"][2])
    rows = [(0, 0, b"", 0, 0, 0, 0, 0, 0), (10, 0x8801, b"\1", 0, 0, 100.0, 0, 0, 0)]
    for k, (chan, off) in enumerate(((1, 0), (2, 32), (1, 64), (2, 96))):
        rows.append((18, 0x8101, b"Wav1", chan, 0, 100.0 + k, off, 2, 1000.0))
    rows += [(10, 0x101, b"Tick", 0, 0, 101.5, 0, 0, 0), (10, 0x101, b"Tick", 0, 0, 102.5, 0, 0, 0), (14, 0x8201, b"eNe1", 1, 3, 101.0, 128, 0, 1000.0), (14, 0x8201, b"eNe1", 1, 3, 102.0, 128, 0, 1000.0)]
    write_records(np.array(rows, kind), f"file://{path}/blk/b.tsq", "tsq")
    (path / "blk" / "b.tev").write_bytes(np.arange(64, dtype="<i2").tobytes() + np.arange(4, dtype="<f4").tobytes())
    return {"Wav1": 32}


def spikeglx(path):
    (path / "run_g0_t0.imec0.ap.bin").write_bytes(np.arange(40, dtype="<i2").tobytes())
    (path / "run_g0_t0.imec0.ap.meta").write_text("nSavedChans=4\ntypeThis=imec\nimAiRangeMax=0.6\nsnsApLfSy=3,0,1\nimroTbl=(0,4)(0 0 0 500 250)(1 0 0 500 250)(2 0 0 500 250)\n")
    return {"run_g0_t0.imec0.ap": 10}


def intan(path):
    body = b"".join(np.arange(60, dtype="<i4").tobytes() + np.full(120, 32768 + k, "<u2").tobytes() + b"\0\0" + np.zeros(60, "<u2").tobytes() for k in range(2))
    (path / "x.rhd").write_bytes(intan_header() + body)
    return {"amplifier": 120, "adc": 120}


def openephys(path):
    rec = path / "exp" / "recording1"
    (rec / "continuous" / "A").mkdir(parents=True)
    (rec / "continuous" / "A" / "continuous.dat").write_bytes(np.arange(20, dtype="<i2").tobytes())
    (rec / "structure.oebin").write_text('{"continuous":[{"folder_name":"A/","sample_rate":30000,"channels":[{"channel_name":"CH1","bit_volts":0.195},{"channel_name":"CH2","bit_volts":3}]}]}')
    return {"A": 10}


def legacy(path):
    kind = np.dtype(FORMATS["oe_continuous"][2])
    for name in ("100_CH1", "100_CH2"):
        r = np.zeros(3, kind)
        r["timestamp"], r["n"] = (1024, 2048, 4096), 1024
        r["samples"] = 5
        write_records(r, f"file://{path}/{name}.continuous", "oe_continuous")
    return {"100_CH1": 5120, "100_CH2": 5120}


def blackrock(path):
    d = np.arange(40).reshape(20, 2)
    (path / "a.ns3").write_bytes(nsx_bytes([(0, d)]))
    ext = b"NEUEVWAV" + struct.pack("<HBBH", 1, 1, 1, 250) + bytes(7) + bytes([2]) + struct.pack("<H", 4) + bytes(8)
    head = 336 + len(ext)
    raw = b"NEURALEV" + bytes([2, 3]) + struct.pack("<HIIII", 1, head, 16, 30000, 30000) + bytes(332 - 28) + struct.pack("<I", 1) + ext
    pk = [struct.pack("<IHBB4h", t, i, r, 0, *w) for t, i, r, w in ((10, 1, 5, (1, 2, 3, 4)), (20, 0, 1, (7, 0, 0, 0)), (40, 0, 1, (8, 0, 0, 0)), (50, 1, 5, (3, 4, 5, 6)))]
    (path / "a.nev").write_bytes(raw + b"".join(pk))
    return {"a.ns3": 20}


def neuralynx(path):
    r = np.zeros(3, np.dtype(FORMATS["ncs"][2]))
    r["timestamp"], r["valid"], r["rate"] = (1000000, 1512000, 2024000), (512, 512, 100), 1000
    r["samples"] = np.arange(3)[:, None]
    write_records(r, f"file://{path}/CSC1.ncs", "ncs", b"######## header\r\n-ADBitVolts 0.5\r\n")
    return {"CSC1": 1124}


MAKE = {"tdt": tdt, "spikeglx": spikeglx, "intan": intan, "openephys": openephys, "openephys-legacy": legacy, "blackrock": blackrock, "neuralynx": neuralynx}


@pytest.mark.parametrize("name", MAKE)
def test_folder(spark, tmp_path, capsys, name):
    src = tmp_path / "in"
    src.mkdir()
    want = MAKE[name](src)
    path = f"file://{src}"
    assert folders.claims(path)[0][0] == name and folders.containers(path)
    session = folders.open_folder(spark, path)
    assert folders.conforms(session) == []
    ends = {}
    for r in session.chunks().collect():
        ends[r.recording] = max(ends.get(r.recording, 0), r.first + len(r["values"]))
    assert {k: ends[k] for k in want} == want
    assert main(["inspect", str(src)]) == 0 and set(want) <= {json.loads(line)["recording"] for line in capsys.readouterr().out.splitlines() if line.startswith("{")}
    assert main(["convert", str(src), f"file://{tmp_path}/out"]) == 0
    assert main(["verify", f"file://{tmp_path}/out"]) == 0
    report = json.loads((tmp_path / "out.report.json").read_text())
    assert report["ok"] and set(want) <= set(report["recordings"])
    tables = {"tdt": {"events": 2, "snippets": 2, "units": 1}, "blackrock": {"events": 2, "snippets": 2, "units": 1}}
    assert {k: v for k, v in report["tables"].items() if k != "metadata"} == tables.get(name, {})
    capsys.readouterr()
    assert main(["containers", str(src)]) == 0 and capsys.readouterr().out.strip()


def test_no_reader(spark, tmp_path):
    (tmp_path / "x.txt").write_text("nothing")
    with pytest.raises(ValueError):
        folders.open_folder(spark, f"file://{tmp_path}")
    own = folders.Format("text", lambda p: 1.0, lambda spark, p: folders.Session("text", metadata={"at": p}))
    assert folders.open_folder(spark, f"file://{tmp_path}", [*folders.FOLDERS, own]).format == "text"


def test_conformance_kit_finds_faults(spark):
    names = "recording string, channel int, first bigint, values array<float>"
    bad = folders.Session("x", chunked=spark.createDataFrame([("r", 0, 0, [1.0, 2.0]), ("r", 0, 3, [1.0]), ("r", 1, 0, [1.0])], names), events=spark.createDataFrame([("e", 0, 2.0, None, 1.0, ""), ("e", 1, 1.0, None, 1.0, ""), ("e", 3, 5.0, None, 1.0, "")], folders.EVENTS))
    said = folders.conforms(bad)
    assert len([s for s in said if s.startswith("signals")]) == 2 and len([s for s in said if s.startswith("events")]) == 2
    good = spark.createDataFrame([("r", 0, 0, [1.0, 2.0]), ("r", 0, 2, [1.0])], names)
    assert folders.conforms(folders.Session("x", chunked=good)) == [] and stretches.samples(good).count() == 3
