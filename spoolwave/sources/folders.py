"""Recording folders of any format as a session of tables: detection, containers, signals, events and snippets."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolwave.sources import blackrock, intan, neuralynx, openephys, spikeglx, stretches, tdt
from spoolwave.sources.files import file_system, listing
from spoolwave.sources.records import FORMATS, RecordSource

EVENTS = "series string, pos bigint, onset double, offset double, value double, label string"
SNIPPETS = "store string, idx bigint, t double, channel int, sort_code int, path string, offset bigint, count int, dtype string, scale double"
# First bytes of the formats' files.
INTAN_MAGIC = tuple(struct.pack("<I", kind) for kind in (intan.RHD, intan.RHS))
BLACKROCK_MAGIC = (b"NEURALSG", b"NEURALCD", b"BRSMPGRP", b"NEURALEV", b"BREVENTS")
NEURALYNX_MAGIC = b"########"


@dataclass
class Session:
    """What a folder holds. Signals are stretches, or chunks where a layout needs its records to be filled up first."""

    format: str
    signals: DataFrame | None = None
    chunked: DataFrame | None = None
    events: DataFrame | None = None
    snippets: DataFrame | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def chunks(self) -> DataFrame:
        """(recording, channel, first, values) of all signals."""
        found = ([stretches.read(self.signals)] if self.signals is not None else []) + ([self.chunked] if self.chunked is not None else [])
        if not found:
            raise ValueError(f"a {self.format} folder without signals")
        return _union(found)

    def waveforms(self) -> DataFrame:
        """(store, idx, t, channel, sort_code, waveform), read where the index says."""
        if self.snippets is None:
            raise ValueError(f"a {self.format} folder without snippets")
        return stretches.payloads(self.snippets, ["store", "idx", "t", "channel", "sort_code"], scale="scale")


@dataclass
class Format:
    """A folder reader: what it claims of a path (0 to 1), the containers below it, and how one opens."""

    name: str
    detect: Callable[[str], float]
    open: Callable[[SparkSession, str], Session]
    containers: Callable[[str], list[str]] = lambda path: [path]


def _union(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def _uri(path: str, near: str) -> str:
    """A listed path as a URI of the same kind as the folder it was found in."""
    return path if "://" in path else f"{near.split('://')[0] if '://' in near else 'file'}://{path}"


def _starts(path: str, suffixes: tuple[str, ...], *magic: bytes) -> bool:
    for suffix in suffixes:
        fs, found = listing(path, suffix)
        for info in found[:8]:
            with fs.open_input_file(info.path) as f:
                if f.read(max(map(len, magic))).startswith(magic):
                    return True
    return False


def _tdt(path: str) -> float:
    return 0.95 if listing(path, ".tsq")[1] else 0.6 if listing(path, ".sev")[1] else 0.0


def _open_tdt(spark: SparkSession, path: str) -> Session:
    out, signals, events, snippets, found = Session("tdt"), [], [], [], tdt.blocks(path)
    for block in found:
        # with several blocks their names tell apart what they hold
        of = (lambda c, b=block.rsplit("/", 1)[-1]: F.concat(F.lit(f"{b}/"), c)) if len(found) > 1 else (lambda c: c)
        block = _uri(block, path)
        rows = tdt.index(spark, block)
        tev = next((i for i in listing(block, ".tev")[1]), None)
        began = F.min(F.when((F.col("type") == 0x8801) & (F.col("name") == "\x01"), F.col("timestamp")))
        start = rows.agg(F.coalesce(began, F.min(F.when(F.col("timestamp") > 0, F.col("timestamp"))), F.lit(0.0)).alias("_start"))
        onsets = rows.where("kind = 'onset' and name >= ' '").crossJoin(F.broadcast(start))  # one row on the right
        w = Window.partitionBy("name").orderBy("k")
        events.append(onsets.select(of(F.col("name")).alias("series"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), (F.col("timestamp") - F.col("_start")).alias("onset"), F.lit(None).cast("double").alias("offset"), F.col("offset").cast("double").alias("value"), F.lit("").alias("label")))
        if tev is not None:
            at = _uri(tev.path, path)
            signals.append(tdt.streams(rows, at).withColumn("recording", of(F.col("recording"))))
            s = tdt.snips(rows, at, tev.size).crossJoin(F.broadcast(start))
            snippets.append(s.select(of(F.col("store")).alias("store"), F.col("seq").cast("bigint").alias("idx"), (F.col("t") - F.col("_start")).alias("t"), F.col("channel").cast("int").alias("channel"), F.col("sort_code").cast("int").alias("sort_code"), "path", F.col("offset").cast("bigint").alias("offset"), F.col("count").cast("int").alias("count"), "dtype", F.lit(1.0).alias("scale")))
    if listing(path, ".sev")[1]:
        own = tdt.sev_stretches(spark, path)[0]
        signals = [own, *(s.join(own.select("recording").distinct(), "recording", "left_anti").select(*own.columns) for s in signals)]  # channel files win (J09)
    out.signals, out.events, out.snippets = (_union(x) if x else None for x in (signals, events, snippets))
    return out


def _spikeglx(path: str) -> float:
    return 0.9 if any(n.stream for found in spikeglx.runs(path).values() for n, _ in found) else 0.0


def _open_spikeglx(spark: SparkSession, path: str) -> Session:
    return Session("spikeglx", spikeglx.run_stretches(spark, path), metadata={"runs": ",".join(sorted(spikeglx.runs(path)))})


def _intan(path: str) -> float:
    return 0.95 if _starts(path, (".rhd", ".rhs"), *INTAN_MAGIC) else 0.0


def _open_intan(spark: SparkSession, path: str) -> Session:
    """A header with blocks behind it is the traditional layout; else one file per type if there is one, else per channel."""
    signals, notes = [], []
    heads = [i for suffix in (".rhd", ".rhs") for i in listing(path, suffix)[1]]
    for info in heads:
        at = _uri(info.path, path)
        fs, where = file_system(at)
        with fs.open_input_file(where) as f:
            h = intan.parse(f.read(min(info.size, 8 << 20)))
        notes += [n for n in h.notes if n]
        folder = at.rsplit("/", 1)[0]
        if info.size > h.size:
            found = intan.traditional_stretches(spark, at)[0]
        elif fs.get_file_info(f"{where.rsplit('/', 1)[0]}/{intan.PER_TYPE['amplifier']}").is_file:
            found = intan.per_type_stretches(spark, folder, h)
        else:
            found = intan.per_channel_stretches(spark, folder, h)[0]
        stem = info.base_name.rsplit(".", 1)[0]
        signals.append(found.withColumn("recording", F.concat(F.lit(f"{stem}."), "recording")) if len(heads) > 1 else found)
    return Session("intan", _union(signals), metadata={"notes": "; ".join(notes)})


def _openephys(path: str) -> float:
    return 0.95 if openephys.walk(path, "structure.oebin") else 0.0


def _open_openephys(spark: SparkSession, path: str) -> Session:
    found = [_uri(f, path) for f in openephys.walk(path, "structure.oebin")]
    parts = [openephys.binary_stretches(spark, f) for f in found]
    if len(parts) > 1:  # a recording folder each
        parts = [p.withColumn("recording", F.concat(F.lit("/".join(f.rsplit("/", 2)[1:]) + "/"), "recording")) for p, f in zip(parts, found)]
    return Session("openephys", _union(parts))


def _legacy(path: str) -> float:
    return 0.9 if any(openephys.legacy_name(i.base_name) for i in listing(path, ".continuous")[1]) else 0.0


def _open_legacy(spark: SparkSession, path: str) -> Session:
    spark.dataSource.register(RecordSource)
    records = spark.read.format("records").option("format", "oe_continuous").load(path)
    chunks = openephys.legacy_chunks(records)
    name = F.regexp_replace("file", r"\.continuous$", "")
    return Session("openephys-legacy", chunked=chunks.select(name.alias("recording"), F.lit(0).alias("channel"), "first", F.col("values").cast("array<float>").alias("values")))


def _blackrock(path: str) -> float:
    return 0.95 if _starts(path, (".nev", *[f".ns{i}" for i in range(1, 10)]), *BLACKROCK_MAGIC) else 0.0


def _open_blackrock(spark: SparkSession, path: str) -> Session:
    out, signals, events, snippets, warnings = Session("blackrock"), [], [], [], []
    sets = blackrock.file_sets(path)
    for base, files in sets.items():
        # with several recordings their names tell apart what they hold
        of = (lambda c, b=base.rsplit("/", 1)[-1]: F.concat(F.lit(f"{b}/"), c)) if len(sets) > 1 else (lambda c: c)
        for file in files:
            at, suffix = _uri(file, path), file.rsplit(".", 1)[1].lower()
            if suffix == "nev":
                h = blackrock.nev(at)
                rows = blackrock.packets(spark, at, h)
                words = blackrock.digital_words(rows, h.spec)
                w = Window.partitionBy("kind").orderBy("pos")
                events.append(words.select(of(F.col("kind")).alias("series"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), (F.col("ticks") / h.resolution).alias("onset"), F.lit(None).cast("double").alias("offset"), F.col("value").cast("double").alias("value"), F.lit("").alias("label")))
                if h.waves:
                    s = blackrock.spikes(spark, rows, at, h)
                    snippets.append(s.select(of(F.col("store")).alias("store"), F.col("pos").alias("idx"), (F.col("ticks") / h.resolution).alias("t"), F.col("channel").cast("int").alias("channel"), F.col("sort_code").cast("int").alias("sort_code"), "path", F.col("offset").cast("bigint").alias("offset"), F.col("count").cast("int").alias("count"), "dtype", "scale"))
            else:
                found, h = blackrock.nsx_stretches(spark, at, f"{base.rsplit('/', 1)[-1]}.{suffix}")
                signals.append(found)
                warnings += h.warnings
    out.signals, out.events, out.snippets = (_union(x) if x else None for x in (signals, events, snippets))
    out.metadata = {"warnings": "; ".join(warnings)}
    return out


def _neuralynx(path: str) -> float:
    return 0.95 if _starts(path, (".ncs", ".nev"), NEURALYNX_MAGIC) else 0.0


def _open_neuralynx(spark: SparkSession, path: str) -> Session:
    """A stretch per record of a signal file, at the gain of the file's own header."""
    out = Session("neuralynx")
    found = listing(path, ".ncs")
    heads = []
    for info in found[1]:
        with found[0].open_input_file(info.path) as f:
            h = neuralynx.header(f.read(neuralynx.HEADER))
        heads.append((info.base_name, _uri(info.path, path), info.base_name.rsplit(".", 1)[0], neuralynx.volts_per_bit(h)[0]))
    if heads:
        _, skip, fields = FORMATS["ncs"]
        size = sum(int(f[1][2:]) * (f[2] if len(f) > 2 else 1) for f in fields)
        before = size - 2 * neuralynx.BLOCK
        files = spark.createDataFrame(heads, "file string, path string, recording string, gain double")  # one row a file
        w = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        rows = neuralynx.ncs(spark, path).select("file", "k", F.col("valid").cast("bigint").alias("samples")).withColumn("first", F.coalesce(F.sum("samples").over(w), F.lit(0).cast("bigint")))
        at = F.lit(skip + before).cast("bigint") + F.col("k") * size
        out.signals = rows.join(files, "file").select(
            "recording", "path", "first", "samples", at.alias("offset"), F.lit("<i2").alias("dtype"), F.lit(2).cast("bigint").alias("step"), F.array(F.lit(0).cast("bigint")).alias("places"),
            F.array(F.lit(0)).alias("channels"), F.array("gain").alias("gains"), F.array(F.lit(0.0)).alias("shifts"),
        )
    if listing(path, ".nev")[1]:
        w = Window.partitionBy("event_id").orderBy("t_us", "k")
        e = neuralynx.events(spark, path)
        out.events = e.select(F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("series"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), (F.col("t_us") / 1e6).alias("onset"), F.lit(None).cast("double").alias("offset"), F.col("ttl").cast("double").alias("value"), F.col("text").alias("label"))
    return out


def _recording_folders(path: str) -> list[str]:
    return [_uri(f, path) for f in openephys.walk(path, "structure.oebin")]


FOLDERS: list[Format] = [
    Format("tdt", _tdt, _open_tdt, lambda p: [_uri(b, p) for b in tdt.blocks(p)] or [p]),
    Format("spikeglx", _spikeglx, _open_spikeglx, lambda p: sorted(spikeglx.runs(p))),
    Format("intan", _intan, _open_intan, lambda p: [_uri(i.path, p) for s in (".rhd", ".rhs") for i in listing(p, s)[1]]),
    Format("openephys", _openephys, _open_openephys, _recording_folders),
    Format("openephys-legacy", _legacy, _open_legacy),
    Format("blackrock", _blackrock, _open_blackrock, lambda p: sorted(blackrock.file_sets(p))),
    Format("neuralynx", _neuralynx, _open_neuralynx),
]


def claims(path: str, formats: list[Format] | None = None) -> list[tuple[str, float]]:
    """(format, confidence) of all that claim the folder, best first, earlier formats first among equals."""
    found = [(f.name, f.detect(path)) for f in (FOLDERS if formats is None else formats)]
    return sorted((c for c in found if c[1] > 0), key=lambda c: -c[1])


def _best(path: str, formats: list[Format] | None) -> Format:
    found = claims(path, formats)
    if not found:
        raise ValueError(f"no reader opens {path}")
    return next(f for f in (FOLDERS if formats is None else formats) if f.name == found[0][0])


def containers(path: str, formats: list[Format] | None = None) -> list[str]:
    """Blocks, runs, recordings or files below a folder that its best claim tells apart."""
    return _best(path, formats).containers(path)


def open_folder(spark: SparkSession, path: str, formats: list[Format] | None = None) -> Session:
    """The folder's session by its best claim; a caller's own formats come in by the last argument."""
    return _best(path, formats).open(spark, path)


def conforms(session: Session) -> list[str]:
    """The reader conformance kit (V11): what is wrong with a session that any reader has made; empty if nothing is.

    Signals must have chunks without nulls that neither overlap nor leave gaps, on channels that all end together; events must have
    dense positions in order of time in every series; snippets of a store must have one length and a waveform each.
    """
    from spoolwave.plans.job import structural_checks

    bad = []
    if session.signals is not None or session.chunked is not None:
        chunks = session.chunks()
        bad += [f"signals: {r.message} ({r.target_name})" for r in structural_checks(chunks).limit(20).collect()]
        ends = chunks.groupBy("recording", "channel").agg(F.max(F.col("first") + F.size("values")).alias("end")).groupBy("recording").agg(F.count_distinct("end").alias("n")).where("n > 1")
        bad += [f"signals: channels of {r.recording} end apart" for r in ends.limit(20).collect()]
    if session.events is not None:
        w = Window.partitionBy("series").orderBy("pos")
        rows = session.events.withColumn("_step", F.col("pos") - F.lag("pos", 1, -1).over(w)).withColumn("_back", F.col("onset") < F.lag("onset").over(w))
        bad += [f"events: {r.series} at {r.pos}" for r in rows.where("_step <> 1 or _back or onset is null").limit(20).collect()]
    if session.snippets is not None:
        w = session.waveforms().groupBy("store").agg(F.count_distinct(F.size("waveform")).alias("n"), F.count_if(F.col("waveform").isNull()).alias("none")).where("n <> 1 or none > 0")
        bad += [f"snippets: {r.store}" for r in w.limit(20).collect()]
    return bad
