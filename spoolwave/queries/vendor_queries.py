"""Vendor layouts: executors write the tables in each binary form, and the readers give the rows back."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolwave.plans.tables import table
from spoolwave.queries.registry import query
from spoolwave.sources import blackrock, folders, intan, neuralynx, openephys, spikeglx, stretches, tdt
from spoolwave.sources.files import file_system, listing, scratch
from spoolwave.sources.records import FORMATS, RecordSource

#: Two files of each form: rows of even and of odd vec_id, i counts within; four channels.
BASE = "(select vec_id, vec_id % 2 as g, row_number() over (partition by vec_id % 2 order by vec_id) - 1 as i, list_transform(embedding, lambda v: round(v::double * 8192)::int) as raw from embeddings)"
LONG = f"(select g, i, unnest(range(0, 4))::int as channel, unnest(raw[1:4]) as v from {BASE})"
FLAT = f"(select g, i * 64 + j as i, raw[j + 1] as v from {BASE}, (select unnest(range(0, 64)) as j))"


def _sums(source: str, rows: str = "true", channel: str = "channel") -> str:
    return f"select g, {channel} as channel, count(*) as n, sum(v)::bigint as total, sum(v * (i % 97))::bigint as mix from {source} where {rows} group by 1, 2"


def deposit(spark, sf: str, make: Callable[[int, np.ndarray, np.ndarray], dict[str, bytes]]) -> str:
    """A folder with what make(g, vec_id, raw) returns for either half of the vectors, as files by name; executors write them."""
    path = scratch(spark, "vendor")
    rows = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % 2).alias("g"), F.transform("embedding", lambda v: F.round(v.cast("double") * 8192).cast("int")).alias("raw")
    )

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("vec_id").to_numpy())
        raw = np.array(t.column("raw").to_pylist(), np.int64)[order]
        for name, data in make(t.column("g")[0].as_py(), t.column("vec_id").to_numpy()[order], raw).items():
            fs, at = file_system(f"{path}/{name}")
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as f:
                f.write(data)
        return pa.table({"rows": pa.array([t.num_rows], pa.int64())})

    rows.groupBy("g").applyInArrow(run, "rows bigint").agg(F.sum("rows")).collect()
    return path


def _summed(long: DataFrame, g) -> DataFrame:
    """The sums of (recording, channel, sample, value) that _sums asks for."""
    v = F.round(F.col("value").cast("double"))
    return long.groupBy(g.cast("bigint").alias("g"), F.col("channel").cast("int").alias("channel")).agg(F.count("*").alias("n"), F.sum(v).cast("bigint").alias("total"), F.sum(v * (F.col("sample") % 97)).cast("bigint").alias("mix"))


def _digit(column: str, pattern: str):
    return F.regexp_extract(column, pattern, 1)


# TDT


def _tsq(rows: list[tuple]) -> bytes:
    return np.array(rows, np.dtype(FORMATS["tsq"][2])).tobytes()


def _block(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
    """A block: packets of eight samples of four channels, then a snippet of eight floats for each vector."""
    rows, tev = [(10, 0x8801, b"\1", 0, 0, 1000.0, 0, 0, 0.0)], io.BytesIO()
    for k in range(len(raw) // 8):
        for c in range(4):
            rows.append((10 + 4, 0x8101, b"Wav1", c + 1, 0, 1000.0 + k, tev.tell(), 2, 25.0))
            tev.write(raw[8 * k : 8 * k + 8, c].astype("<i2").tobytes())
    for k, i in enumerate(ids.tolist()):
        rows.append((10 + 8, 0x8201, b"eNe1", i % 4 + 1, i % 3, 1000.0 + k, tev.tell(), 0, 25.0))
        tev.write(raw[k, :8].astype("<f4").tobytes())
    return {f"blk{g}/b.tsq": _tsq(rows), f"blk{g}/b.tev": tev.getvalue(), f"blk{g}/b.SortResult": bytes(1024) + bytes(k * 7 % 5 for k in range(len(rows)))}


@query("s12_blocks", "select distinct 'blk' || (vec_id % 2) as block from embeddings")
def s12(spark, sf):
    path = deposit(spark, sf, _block)
    return spark.createDataFrame([(b.rsplit("/", 1)[-1],) for b in folders.containers(path)], "block string")


@query("s16_packet_streams", _sums(LONG, f"i < (select count(*) from {BASE} b where b.g = g) // 8 * 8", "channel + 1").replace("b.g = g", "b.g = l.g").replace(f"from {LONG} where", f"from {LONG} l where"))
def s16(spark, sf):
    long = stretches.samples(stretches.read(folders.open_folder(spark, deposit(spark, sf, _block)).signals))
    return _summed(long, _digit("recording", r"blk(\d)/"))


@query(
    "s22_snippets",
    f"select g, vec_id % 4 + 1 as channel, vec_id % 3 as sort_code, count(*) as n, sum(list_sum(raw[1:8]))::bigint as total, min(i)::double as first from {BASE} group by 1, 2, 3",
)
def s22(spark, sf):
    w = folders.open_folder(spark, deposit(spark, sf, _block)).waveforms()
    total = F.aggregate("waveform", F.lit(0.0), lambda a, v: a + v.cast("double"))
    out = w.groupBy(_digit("store", r"blk(\d)/").cast("bigint").alias("g"), F.col("channel").cast("bigint").alias("channel"), F.col("sort_code").cast("bigint").alias("sort_code"))
    return out.agg(F.count("*").alias("n"), F.sum(total).cast("bigint").alias("total"), F.min("t").alias("first"))


@query("s14_index", f"select g, case when k = 0 then 'onset' when k <= p then 'stream' else 'snip' end as kind, count(*) as n, sum(greatest(k - 1, 0))::bigint as seqs from (select g, p, unnest(range(0, 1 + p + c)) as k from (select g, (count(*) // 8) * 4 as p, count(*) as c from {BASE} group by 1)) group by 1, 2")
def s14(spark, sf):
    path = deposit(spark, sf, _block)
    rows = [tdt.index(spark, f"{path}/blk{g}/b.tsq").select(F.lit(g).cast("bigint").alias("g"), "kind", "k", "seq", "name") for g in (0, 1) if listing(f"{path}", f"blk{g}/b.tsq")[1]]
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    # the mark that opens a block has a name of one unprintable byte, which counts
    return both.groupBy("g", "kind").agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("seq") - 1, F.lit(0))).cast("bigint").alias("seqs"))


@query("s23_offline_sorts", f"select g, (i + 1 + (select (count(*) // 8) * 4 from {BASE} b where b.g = a.g)) * 7 % 5 as code, count(*) as n from {BASE} a group by 1, 2")
def s23(spark, sf):
    path, parts = deposit(spark, sf, _block), []
    for g in (0, 1):
        tev = listing(path, f"blk{g}/b.tev")[1]
        if tev:
            idx = tdt.index(spark, f"{path}/blk{g}/b.tsq")
            s = tdt.snips(idx, f"{path}/blk{g}/b.tev", tev[0].size, tdt.sort_result(spark, f"{path}/blk{g}/b.SortResult"))
            parts.append(s.select(F.lit(g).cast("bigint").alias("g"), F.col("sort_code").cast("bigint").alias("code")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("g", "code").agg(F.count("*").alias("n"))


def _sev(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
    """Channel files of a store, an hour file for every 40 samples."""
    head = lambda c: struct.pack("<Q3sB4sHHHHBBH", 0, b"SEV", 3, f"Raw{g}".encode(), c, 2, 4, 0, 2, 1, 12).ljust(40, b"\0")
    out = {}
    for c in range(4):
        for h in range(-(-len(raw) // 40)):
            out[f"t_b_Raw{g}_Ch{c + 1}{f'-{h}h' if h else ''}.sev"] = head(c + 1) + raw[40 * h : 40 * h + 40, c].astype("<i2").tobytes()
    return out


@query("s20_hour_files", _sums(LONG, "true", "channel + 1"))
def s20(spark, sf):
    st, _ = tdt.sev_stretches(spark, deposit(spark, sf, _sev))
    return _summed(stretches.samples(stretches.read(st)), _digit("recording", r"Raw(\d)"))


@query("s18_channel_headers", "select distinct 'Raw' || (vec_id % 2) as store, 4 as channels, 2 as format from embeddings")
def s18(spark, sf):
    path = deposit(spark, sf, _sev)
    fs, found = listing(path, ".sev")
    heads = []
    for info in found:
        with fs.open_input_file(info.path) as f:
            h = tdt.sev_header(f.read(tdt.SEV_HEADER))
        heads.append((h["store"], h["channel"], h["format"]))
    return spark.createDataFrame(heads, "store string, channel int, format int").groupBy("store").agg(F.count_distinct("channel").cast("int").alias("channels"), F.max("format").alias("format"))


def _texts(spark, sf, line, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Sidecar texts, one a nation, parsed by executors: rows of (n_nationkey, *fields)."""
    texts = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), line.alias("text"))

    def run(batches):
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parse(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    names = ["k", *(f.strip().split(" ")[0] for f in schema.split(","))]
    return texts.mapInArrow(run, f"k bigint, {schema}")


@query("s26_notes", "select n_nationkey::bigint as k, '10:00:05am' as clock, n_name as button, 'region ' || n_regionkey as note from nation")
def s26(spark, sf):
    text = F.concat(F.lit("Experiment: E\nStart: 10:00:00am 01/01/2020\n\nNote-1: 10:00:05am ["), "n_name", F.lit('] "region '), F.col("n_regionkey").cast("string"), F.lit('"\nStop: 11:00:00am\n'))
    return _texts(spark, sf, text, lambda t: tdt.synapse_notes(t)[1], "clock string, button string, note string")


@query("s27_stores", "select n_nationkey::bigint as k, 'Wav1' as store, n_name as object from nation")
def s27(spark, sf):
    text = F.concat(F.lit("Object ID : "), "n_name", F.lit(" - Processor\n Store ID : Wav1\n Source : Amp"))
    return _texts(spark, sf, text, lambda t: [(s, d["object"]) for s, d in tdt.store_listing(t).items()], "store string, object string")


@query("s29_text_notes", "select n_nationkey::bigint as k, unnest([n_name, 'r' || n_regionkey]) as note from nation")
def s29(spark, sf):
    text = F.concat(F.lit("version 1\n  "), "n_name", F.lit("  \n\n r"), F.col("n_regionkey").cast("string"), F.lit("\n"))
    return _texts(spark, sf, text, lambda t: [(n,) for n in tdt.tnt_notes(t)], "note string")


@query("s30_gap_log", "select n_nationkey::bigint as k, 7::bigint as start, (10 + n_nationkey)::bigint as last, (20 + n_regionkey)::bigint as next from nation")
def s30(spark, sf):
    text = F.concat(F.lit("recording started at sample: 7\ngap detected. last saved sample: "), (F.col("n_nationkey") + 10).cast("string"), F.lit(", new saved sample: "), (F.col("n_regionkey") + 20).cast("string"))
    return _texts(spark, sf, text, lambda t: [(tdt.gap_log(t)[0], *gap) for gap in tdt.gap_log(t)[1]], "start bigint, last bigint, next bigint")


@query("s28_archive_summary", "select n_nationkey::bigint as k, 'Session.Name' as key, n_name as value from nation")
def s28(spark, sf):
    def parse(t: str) -> list[tuple]:
        import zipfile

        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("Summary.txt", t)
        return list(tdt.tin_summary(buf.getvalue()).items())

    return _texts(spark, sf, F.concat(F.lit("[Session]\nName="), "n_name", F.lit("\nOther=NONE\n")), parse, "key string, value string")


# SpikeGLX


def _run(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
    meta = "nSavedChans=4\ntypeThis=imec\nimAiRangeMax=0.6\nsnsApLfSy=3,0,1\nimroTbl=(0,4)(0 0 0 500 250)(1 0 0 500 250)(2 0 0 500 250)\n"
    return {f"run_g0/run_g0_t{g}.imec0.ap.bin": raw[:, :4].astype("<i2").tobytes(), f"run_g0/run_g0_t{g}.imec0.ap.meta": meta.encode()}


@query("s34_probe_streams", _sums(LONG))
def s34(spark, sf):
    long = stretches.samples(stretches.read(folders.open_folder(spark, deposit(spark, sf, _run)).signals, scaled=False))
    return _summed(long, _digit("recording", r"_t(\d)"))


@query("s31_runs", "select distinct 'run_g0' as run, (vec_id % 2)::varchar as trigger, 'imec0' as stream from embeddings")
def s31(spark, sf):
    found = spikeglx.runs(deposit(spark, sf, _run))
    return spark.createDataFrame([(run, n.trigger, n.stream) for run, names in found.items() for n, _ in names], "run string, trigger string, stream string")


# Intan


def _text16(s: str) -> bytes:
    return struct.pack("<I", len(s) * 2) + s.encode("utf-16-le")


def _intan_head(channels: int) -> bytes:
    h = struct.pack("<Ihhf", intan.RHD, 1, 3, 20000.0) + struct.pack("<hff", 1, 1.0, 0.1) + struct.pack("<f", 7500.0) + struct.pack("<3f", 1, 1, 1) + struct.pack("<hff", 0, 1, 1)
    h += _text16("note") + _text16("") + _text16("") + struct.pack("<h", 0) + struct.pack("<h", 0) + struct.pack("<h", 1) + _text16("Port A") + _text16("A") + struct.pack("<hhh", 1, channels, channels)
    for i in range(channels):
        h += _text16(f"A-{i:03d}") + _text16(f"c{i}") + struct.pack("<5h", i, i, 0, 1, 0) + struct.pack("<h", 0) + struct.pack("<4h", 0, 0, 0, 0) + struct.pack("<ff", 1e5, 0.0)
    return h


def _intan(layout: str):
    def make(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
        head, own = _intan_head(4), raw[:, :4]
        if layout == "blocks":
            body = b"".join(np.arange(60, dtype="<i4").tobytes() + (own[60 * k : 60 * k + 60].T + 32768).astype("<u2").tobytes() for k in range(len(own) // 60))
            return {f"d{g}/x{g}.rhd": head + body}
        if layout == "types":
            return {f"d{g}/x{g}.rhd": head, f"d{g}/amplifier.dat": own.astype("<i2").tobytes()}
        return {f"d{g}/x{g}.rhd": head, **{f"d{g}/amp-A-{c:03d}.dat": own[:, c].astype("<i2").tobytes() for c in range(4)}}

    return make


def _intan_sums(spark, sf, layout: str) -> DataFrame:
    st = folders.open_folder(spark, deposit(spark, sf, _intan(layout))).signals
    # the offset of offset-binary samples comes back by the shift; the gain is taken off again
    long = stretches.samples(stretches.read(st)).withColumn("value", F.col("value").cast("double") / 0.195e-6)
    return _summed(long, _digit("recording", r"x(\d)\."))


@query("s36_blocks", _sums(LONG, f"i < (select count(*) from {BASE} b where b.g = l.g) // 60 * 60").replace(f"from {LONG} where", f"from {LONG} l where"))
def s36(spark, sf):
    return _intan_sums(spark, sf, "blocks")


@query("s37_file_per_type", _sums(LONG))
def s37(spark, sf):
    return _intan_sums(spark, sf, "types")


@query("s38_file_per_channel", _sums(LONG))
def s38(spark, sf):
    return _intan_sums(spark, sf, "channels")


@query("s35_header", "select distinct 'x' || (vec_id % 2) || '.rhd' as file, 4 as channels, 20000.0::double as rate, 60 as block from embeddings")
def s35(spark, sf):
    path, rows = deposit(spark, sf, _intan("types")), []
    fs, found = listing(path, ".rhd")
    for info in found:
        with fs.open_input_file(info.path) as f:
            h = intan.parse(f.read())
        rows.append((info.base_name, len(h.of("amplifier")), float(h.rate), h.block))
    return spark.createDataFrame(rows, "file string, channels int, rate double, block int")


# Open Ephys


def _binary(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
    rec = f"exp{g}/recording1"
    spec = {"continuous": [{"folder_name": "A/", "sample_rate": 25, "channels": [{"channel_name": f"CH{c + 1}", "bit_volts": 1.0, "units": "V"} for c in range(4)]}]}
    npy = io.BytesIO()
    np.save(npy, ids.astype("<i8"))
    return {f"{rec}/structure.oebin": json.dumps(spec).encode(), f"{rec}/continuous/A/continuous.dat": raw[:, :4].astype("<i2").tobytes(), f"{rec}/continuous/A/sample_numbers.npy": npy.getvalue()}


@query("s41_interleaved_file", _sums(LONG))
def s41(spark, sf):
    st = folders.open_folder(spark, deposit(spark, sf, _binary)).signals
    return _summed(stretches.samples(stretches.read(st)), _digit("recording", r"exp(\d)/"))


@query("s42_array_file", "select vec_id % 2 as g, vec_id as id from embeddings")
def s42(spark, sf):
    path = deposit(spark, sf, _binary)
    _, found = listing(path, ".npy")
    files = spark.createDataFrame([(i.path,) for i in found], "path string").repartition(len(found))

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                fs, _ = file_system(path)
                with fs.open_input_file(p) as f:
                    a = openephys.npy(f.read())
                yield pa.RecordBatch.from_arrays([pa.array(a % 2), pa.array(a)], names=["g", "id"])

    return files.mapInArrow(run, "g bigint, id bigint")


@query("s56_walk", "select distinct 'exp' || (vec_id % 2) || '/recording1' as folder from embeddings")
def s56(spark, sf):
    found = openephys.walk(deposit(spark, sf, _binary), "structure.oebin")
    return spark.createDataFrame([("/".join(f.rsplit("/", 2)[1:]),) for f in found], "folder string")


def _legacy(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
    """All values of a half as one channel, in records of 1024; the third record is missing."""
    flat = raw.ravel()
    n = len(flat) // 1024
    r = np.zeros(n, np.dtype(FORMATS["oe_continuous"][2]))
    r["timestamp"], r["n"] = np.arange(n) * 1024, 1024
    r["samples"] = flat[: n * 1024].reshape(n, 1024)
    return {f"d{g}/100_CH{g + 1}.continuous": bytes(1024) + r[np.arange(n) != 2].tobytes()}


@query(
    "s44_legacy_records",
    f"select g, count(*) as n, sum(case when i // 1024 = 2 then 0 else v end)::bigint as total, sum(case when i // 1024 = 2 then 0 else v * (i % 97) end)::bigint as mix from {FLAT} f"
    f" where i < 1024 * (select min(c // 1024) from (select count(*) as c from {FLAT} group by g)) group by 1",
)
def s44(spark, sf):
    chunks = folders.open_folder(spark, deposit(spark, sf, _legacy)).chunks()
    return _summed(stretches.samples(chunks), _digit("recording", r"CH(\d)").cast("int") - 1).drop("channel")


@query("s46_legacy_spikes", f"select g, i as k, unnest(range(0, 2))::int as channel, unnest([list_sum(raw[1:3]), list_sum(raw[4:6])])::bigint as total from {BASE}")
def s46(spark, sf):
    kind = np.dtype([("head", "V42"), ("wave", "<u2", (2, 3)), ("gain", "<f4", (2,)), ("threshold", "<u2", (2,)), ("recording", "<u2")])

    def make(g, ids, raw):
        r = np.zeros(len(raw), kind)
        r["wave"], r["gain"] = raw[:, :6].reshape(-1, 2, 3) + 32768, 1000.0
        return {f"SE{g}.spikes": bytes(1024) + r.tobytes()}

    path = deposit(spark, sf, make)
    parts = [openephys.legacy_spikes(spark, f"{path}/SE{g}.spikes", 2, 3).withColumn("g", F.lit(g).cast("bigint")) for g in (0, 1) if listing(path, f"se{g}.spikes")[1]]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.select("g", "k", "channel", F.round(F.aggregate("waveform", F.lit(0.0), lambda a, v: a + v.cast("double") * 1e6)).cast("bigint").alias("total"))


# Blackrock


def _nsx(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
    """A signal file of two data blocks, and an event file with a digital word and a spike for each vector."""
    head = 314 + 66 * 4
    h = b"NEURALCD" + bytes([2, 3]) + struct.pack("<I", head) + b"lab".ljust(16, b"\0") + bytes(256) + struct.pack("<II", 30, 30000) + struct.pack("<8H", *[2020, 1, 0, 1, 0, 0, 0, 0]) + struct.pack("<I", 4)
    for c in range(4):
        h += b"CC" + struct.pack("<H", c + 1) + f"e{c}".encode().ljust(16, b"\0") + b"\1\1" + struct.pack("<4h", -1000, 1000, -250, 250) + b"uV".ljust(16, b"\0") + bytes(20)
    half = len(raw) // 2
    blocks = [(0, raw[:half, :4]), (10**6, raw[half:, :4])]
    signal = h + b"".join(struct.pack("<BII", 1, at, len(d)) + d.astype("<i2").tobytes() for at, d in blocks)
    ext = b"NEUEVWAV" + struct.pack("<HBBH", 1, 1, 1, 1000) + bytes(7) + bytes([2]) + struct.pack("<H", 4) + bytes(8)
    nev = b"NEURALEV" + bytes([2, 3]) + struct.pack("<HIIII", 1, 336 + len(ext), 16, 30000, 30000) + bytes(332 - 28) + struct.pack("<I", 1) + ext
    packets = b"".join(struct.pack("<IHBB4h", 30 * k, 0, 1, 0, i % 30000, 0, 0, 0) + struct.pack("<IHBB4h", 30 * k + 1, 1, i % 5, 0, *w) for k, (i, w) in enumerate(zip(ids.tolist(), raw[:, :4].tolist())))
    return {f"r{g}.ns3": signal, f"r{g}.nev": nev + packets}


@query("s48_signal_blocks", f"select g, case when i < h then 1 else 2 end as part, channel, count(*) as n, sum(v)::bigint as total, sum(v * ((case when i < h then i else i - h end) % 97))::bigint as mix from (select l.*, (select count(*) // 2 from {BASE} b where b.g = l.g) as h from {LONG} l) group by 1, 2, 3")
def s48(spark, sf):
    st = folders.open_folder(spark, deposit(spark, sf, _nsx)).signals
    long = stretches.samples(stretches.read(st, scaled=False)).withColumn("part", _digit("recording", r"\.p(\d)$").cast("int"))
    v = F.col("value").cast("double")
    return long.groupBy(_digit("recording", r"r(\d)\.").cast("bigint").alias("g"), "part", "channel").agg(F.count("*").alias("n"), F.sum(v).cast("bigint").alias("total"), F.sum(v * (F.col("sample") % 97)).cast("bigint").alias("mix"))


@query("s49_event_packets", f"select count(*) as n, sum(vec_id % 30000)::bigint as total, max(i) * 30 / 30000.0::double as last from {BASE}")
def s49(spark, sf):
    e = folders.open_folder(spark, deposit(spark, sf, _nsx)).events
    return e.where("series like '%digital'").agg(F.count("*").alias("n"), F.sum("value").cast("bigint").alias("total"), F.max("onset").alias("last"))


@query("s50_spike_waveforms", f"select vec_id % 5 as sort_code, count(*) as n, sum(list_sum(raw[1:4]))::bigint as total from {BASE} group by 1")
def s50(spark, sf):
    w = folders.open_folder(spark, deposit(spark, sf, _nsx)).waveforms()
    total = F.aggregate("waveform", F.lit(0.0), lambda a, v: a + F.round(v.cast("double") * 1e6))
    return w.groupBy(F.col("sort_code").cast("bigint").alias("sort_code")).agg(F.count("*").alias("n"), F.sum(total).cast("bigint").alias("total"))


@query("s47_file_sets", "select distinct 'r' || (vec_id % 2) as base, 2 as files from embeddings")
def s47(spark, sf):
    return spark.createDataFrame([(k.rsplit("/", 1)[-1], len(v)) for k, v in blackrock.file_sets(deposit(spark, sf, _nsx)).items()], "base string, files int")


# Neuralynx


def _csc(g: int, ids: np.ndarray, raw: np.ndarray) -> dict[str, bytes]:
    """All values of a half in records of 512, the last one partly valid; an event for each vector; spikes of two wires."""
    flat = raw.ravel()
    n = -(-len(flat) // 512)
    r = np.zeros(n, np.dtype(FORMATS["ncs"][2]))
    r["samples"] = np.pad(flat, (0, n * 512 - len(flat))).reshape(n, 512)
    r["valid"], r["rate"], r["timestamp"] = 512, 1000, 1_000_000 + np.arange(n) * 512_000
    r["valid"][-1] = len(flat) - (n - 1) * 512
    head = b"######## header\r\n-ADBitVolts 1\r\n".ljust(16384, b"\0")
    e = np.zeros(len(ids), np.dtype(FORMATS["nlx_events"][2]))
    e["timestamp"], e["event_id"], e["ttl"] = 1_000_000 + np.arange(len(ids)) * 1000, ids % 3, ids % 256
    s = np.zeros(len(ids), np.dtype([("timestamp", "<u8"), ("entity", "<u4"), ("cell", "<u4"), ("features", "<u4", (8,)), ("data", "<i2", (4, 2))]))
    s["data"], s["cell"] = raw[:, :8].reshape(-1, 4, 2), ids % 4
    return {f"CSC{g}.ncs": head + r.tobytes(), f"Events{g}.nev": head + e.tobytes(), f"ST{g}.nst": head + s.tobytes()}


@query("s53_signal_records", f"select g, count(*) as n, sum(v)::bigint as total, sum(v * (i % 97))::bigint as mix from {FLAT} group by 1")
def s53(spark, sf):
    st = folders.open_folder(spark, deposit(spark, sf, _csc)).signals
    return _summed(stretches.samples(stretches.read(st)), _digit("recording", r"CSC(\d)")).drop("channel")


@query("s52_record_table", f"select g, (c + 511) // 512 as records, c as valid from (select g, count(*) as c from {FLAT} group by 1)")
def s52(spark, sf):
    r = neuralynx.ncs(spark, deposit(spark, sf, _csc))
    return r.groupBy(_digit("file", r"CSC(\d)").cast("bigint").alias("g")).agg(F.count("*").alias("records"), F.sum("valid").cast("bigint").alias("valid"))


@query("s54_spike_records", f"select g, i as k, vec_id % 4 as cell, unnest([0, 1])::int as wire, unnest([raw[1] + raw[3] + raw[5] + raw[7], 2 * (raw[2] + raw[4] + raw[6] + raw[8])])::bigint as total from {BASE}")
def s54(spark, sf):
    path = deposit(spark, sf, _csc)
    parts = [neuralynx.spikes(spark, f"{path}/ST{g}.nst", 2, 4, [1.0, 2.0]).withColumn("g", F.lit(g).cast("bigint")) for g in (0, 1) if listing(path, f"st{g}.nst")[1]]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.select("g", "k", F.col("cell").cast("bigint").alias("cell"), "wire", F.aggregate("waveform", F.lit(0.0), lambda a, v: a + v.cast("double")).cast("bigint").alias("total"))


@query("s55_event_records", "select 'event_' || (vec_id % 3) as series, count(*) as n, sum(vec_id % 256)::bigint as total from embeddings group by 1")
def s55(spark, sf):
    e = folders.open_folder(spark, deposit(spark, sf, _csc)).events
    return e.groupBy("series").agg(F.count("*").alias("n"), F.sum("value").cast("bigint").alias("total"))


# All formats


MAKERS = {"tdt": _block, "spikeglx": _run, "intan": _intan("types"), "openephys": _binary, "openephys-legacy": _legacy, "blackrock": _nsx, "neuralynx": _csc}


@query("n01_decode", f"select g, t as dtype, count(*) as n, sum(v)::bigint as total from (select g, unnest(['<f4', '<i4', '<i2', '<i1', '<f8', '<i8', '<u2']) as t, raw[1] % 100 as v from {BASE}) group by 1, 2")
def n01(spark, sf):
    kinds = ("<f4", "<i4", "<i2", "<i1", "<f8", "<i8", "<u2")

    def make(g, ids, raw):
        v = np.sign(raw[:, 0]) * (np.abs(raw[:, 0]) % 100)
        return {f"{k[1:]}.g{g}.dat": (v + (100 if k[1] == "u" else 0)).astype(k).tobytes() for k in kinds}

    _, found = listing(path := deposit(spark, sf, make), ".dat")
    rows = []
    for i in found:
        k = "<" + i.base_name.split(".")[0]
        size = np.dtype(k).itemsize
        rows.append(stretches.stretch(i.base_name, folders._uri(i.path, path), i.size // size, 0, k, size, [0], None, None, [-100.0 if k[1] == "u" else 0.0]))
    long = stretches.samples(stretches.read(stretches.table(spark, rows)))
    return long.groupBy(_digit("recording", r"g(\d)").cast("bigint").alias("g"), F.concat(F.lit("<"), F.regexp_extract("recording", r"^([^.]+)", 1)).alias("dtype")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).cast("bigint").alias("total"))


@query("s08_words", f"select g, count(*) as n, sum(raw[1] + 32768)::bigint as total from {BASE} group by 1")
def s08(spark, sf):
    path = deposit(spark, sf, lambda g, ids, raw: {f"w{g}.dat": (raw[:, 0] + 32768).astype("<u2").tobytes()})
    spark.dataSource.register(RecordSource)
    rows = spark.read.format("records").option("format", "words").load(path)
    return rows.groupBy(_digit("file", r"w(\d)").cast("bigint").alias("g")).agg(F.count("*").alias("n"), F.sum("word").cast("bigint").alias("total"))
