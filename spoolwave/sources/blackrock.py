"""NSx signals and NEV packets."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolwave.sources import stretches
from spoolwave.sources.files import file_system, listing

UNITS = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "nV": 1e-9}


def text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").strip()


def file_sets(path: str) -> dict[str, list[str]]:
    """Files of each recording by base name: .nev and .ns1 to .ns9."""
    out: dict[str, list[str]] = {}
    for suffix in (".nev", *[f".ns{i}" for i in range(1, 10)]):
        for i in listing(path, suffix)[1]:
            out.setdefault(i.path[: -len(suffix)], []).append(i.path)
    return out


@dataclass
class Nsx:
    spec: str
    label: str
    period: int
    resolution: int
    channels: list[dict]
    parts: list[tuple[int, int, int]]  # time stamp, samples, byte
    stride: int
    warnings: list[str] = field(default_factory=list)

    @property
    def rate(self) -> float:
        return 30000.0 / max(self.period, 1)


def _scale(c: dict) -> tuple[float, float]:
    """Gain and shift to volts; 1 and 0 without a unit or range."""
    span = c["max_digital"] - c["min_digital"]
    if c["units"] not in UNITS or not span:
        return 1.0, 0.0
    gain = (c["max_analog"] - c["min_analog"]) / span
    return gain * UNITS[c["units"]], (c["min_analog"] - c["min_digital"] * gain) * UNITS[c["units"]]


def nsx(path: str) -> Nsx:
    """Header and data blocks of a signal file: 2.1, 2.2 to 2.3, 3.0 and one-sample PTP blocks."""
    fs, where = file_system(path)
    size = fs.get_file_info(where).size
    with fs.open_input_file(where) as f:
        raw = f.read(min(size, 1 << 20))
        if raw[:8] == b"NEURALSG":
            period, count = struct.unpack_from("<II", raw, 24)
            ids = struct.unpack_from(f"<{count}I", raw, 32)
            head = 32 + 4 * count
            chans = [{"id": i, "label": f"chan{i}" if i < 129 else f"ainp{i - 128}", "units": "", "front_end": i < 129} for i in ids]
            return Nsx("2.1", text(raw[8:24]), period, 30000, [c | {"gain": 1.0, "shift": 0.0} for c in chans], [(0, (size - head) // (2 * max(count, 1)), head)], 2 * max(count, 1))
        if raw[:8] not in (b"NEURALCD", b"BRSMPGRP"):
            raise ValueError(f"{path}: not an NSx file")
        head = struct.unpack_from("<I", raw, 10)[0]
        period, resolution = struct.unpack_from("<II", raw, 286)
        count = struct.unpack_from("<I", raw, 310)[0]
        if head < 314 + 66 * count or len(raw) < head:
            raise ValueError(f"{path}: truncated channel headers")
        chans = []
        for c in range(314, 314 + 66 * count, 66):
            low, high, alow, ahigh = struct.unpack_from("<4h", raw, c + 22)
            one = {"id": struct.unpack_from("<H", raw, c + 2)[0], "label": text(raw[c + 4 : c + 20]), "min_digital": low, "max_digital": high, "min_analog": alow, "max_analog": ahigh, "units": text(raw[c + 30 : c + 46])}
            one["gain"], one["shift"] = _scale(one)
            one["front_end"] = one["units"] == "uV"
            chans.append(one)
        wide = raw[8] >= 3
        stamp, row = struct.Struct("<BQI" if wide else "<BII"), 2 * max(count, 1)
        out = Nsx(f"{raw[8]}.{raw[9]}", text(raw[14:30]), period, resolution, chans, [], row)
        f.seek(head)
        first = f.read(stamp.size)
        if wide and resolution == 1_000_000_000 and len(first) == stamp.size and stamp.unpack(first)[2] == 1:
            out.stride = stamp.size + row
            n = (size - head) // out.stride
            limit = int(2.0 / out.rate * 1e9)
            start, before, begun = 0, None, 0
            step = max(1, (8 << 20) // out.stride)
            for a in range(0, n, step):
                m = min(step, n - a)
                ts = np.ndarray((m,), "<u8", f.read_at(m * out.stride, head + a * out.stride), 1, (out.stride,)).astype(np.int64)
                jumps = np.flatnonzero(np.diff(ts, prepend=ts[0] if before is None else before) > limit)
                begun = int(ts[0]) if a == 0 else begun
                for j in jumps.tolist():
                    out.parts.append((begun, a + j - start, head + start * out.stride + stamp.size))
                    start, begun = a + j, int(ts[j])
                before = int(ts[-1])
            if n > start:
                out.parts.append((begun, n - start, head + start * out.stride + stamp.size))
            return out
        at = head
        while at + stamp.size <= size:
            flag, ts, n = stamp.unpack(f.read_at(stamp.size, at))
            if flag != 1:
                out.warnings.append(f"data block header at byte {at} is not 1; the rest of the file is skipped")
                break
            room = (size - at - stamp.size) // row
            if n > room:
                out.warnings.append(f"the last data block holds {n} samples but the file ends after {room}")
            out.parts.append((ts, min(n, room), at + stamp.size))
            at += stamp.size + n * row
    return out


def nsx_stretches(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, Nsx]:
    """Stretches of a signal file, a recording per part when there are several (W23); parts under two samples go."""
    h = nsx(path)
    parts = [p for p in h.parts if p[1] >= 2]
    n = len(h.channels)
    rows = [
        stretches.stretch(f"{name}.p{k + 1}" if len(parts) > 1 else name, path, samples, at, "<i2", h.stride, [2 * c for c in range(n)], None, [c["gain"] for c in h.channels], [c["shift"] for c in h.channels])
        for k, (_, samples, at) in enumerate(parts)
    ]
    return stretches.table(spark, rows), h


@dataclass
class Nev:
    spec: str
    header: int
    packet_bytes: int
    resolution: int
    waves: dict[int, tuple[int, int, int]]  # id -> nV per bit, bytes per sample, samples
    labels: dict[int, str]
    all_int16: bool

    @property
    def stamp_bytes(self) -> int:
        return 8 if self.spec >= "3.0" else 4


def nev(path: str) -> Nev:
    """Header of an event file with its wave and label extensions."""
    fs, where = file_system(path)
    with fs.open_input_file(where) as f:
        raw = f.read(336)
        if len(raw) < 336 or raw[:8] not in (b"NEURALEV", b"BREVENTS"):
            raise ValueError(f"{path}: not a NEV file")
        flags, head, packet, resolution = struct.unpack_from("<HIII", raw, 10)
        ext = struct.unpack_from("<I", raw, 332)[0]
        more = f.read(32 * ext)
    out = Nev(f"{raw[8]}.{raw[9]}", head, packet, resolution, {}, {}, flags & 1 == 1)
    for at in range(0, len(more) - 31, 32):
        kind, ident = more[at : at + 8], struct.unpack_from("<H", more, at + 8)[0]
        if kind == b"NEUEVWAV":
            digit, size = struct.unpack_from("<H", more, at + 12)[0], more[at + 21]
            out.waves[ident] = (digit, size or 1, struct.unpack_from("<H", more, at + 22)[0] if out.spec >= "2.2" else 0)
        elif kind == b"NEUEVLBL":
            out.labels[ident] = text(more[at + 10 : at + 26])
    return out


def packets(spark: SparkSession, path: str, h: Nev) -> DataFrame:
    """(pos, ticks, id, reason, value, offset, restart): packets of the ids that are read, in file order."""
    fs, where = file_system(path)
    n = (fs.get_file_info(where).size - h.header) // h.packet_bytes
    step = max(1, (16 << 20) // h.packet_bytes)
    tsb, size, head = h.stamp_bytes, h.packet_bytes, h.header
    ranges = spark.createDataFrame([(a, min(step, n - a)) for a in range(0, n, step)] or [(0, 0)], "a bigint, n bigint").repartition(max(1, -(-n // step)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, m in zip(batch.column("a").to_pylist(), batch.column("n").to_pylist()):
                if not m:
                    continue
                own, local = file_system(path)
                with own.open_input_file(local) as f:
                    raw = f.read_at(m * size, head + a * size)
                col = lambda code, at: np.ndarray((m,), code, raw, at, (size,))
                ids = col("<u2", tsb).astype(np.int32)
                keep = (ids <= 2048) | (ids == 0xFFFF)
                said = np.array([raw[k * size + tsb + 12 : k * size + tsb + 34] == b"critical load restart" + b"\0" or raw[k * size + tsb + 12 : k * size + tsb + 33] == b"critical load restart" for k in range(m)], bool) & (ids == 0xFFFF)
                pos = np.arange(a, a + m)
                value = col("<u2", tsb + 4).astype(np.int32) if size >= tsb + 6 else np.zeros(m, np.int32)
                cols = [pos, col("<u8" if tsb == 8 else "<u4", 0).astype(np.int64), ids, col("u1", tsb + 2).astype(np.int32), value, head + pos * size, said]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["pos", "ticks", "id", "reason", "value", "offset", "restart"])

    return ranges.mapInArrow(run, "pos bigint, ticks bigint, id int, reason int, value int, offset bigint, restart boolean")


def digital_words(rows: DataFrame, spec: str) -> DataFrame:
    """(kind, pos, ticks, value): parallel and serial words; reason flags differ before 2.3."""
    bit = F.col("reason").bitwiseAND(F.lit(1)) != 0
    serial = F.col("reason").bitwiseAND(F.lit(128)) != 0
    kind = F.when(bit & serial, "serial").when(bit, "digital")
    if spec < "2.3":
        kind = F.when(serial, "serial").when(bit, "digital")
    return rows.where("id = 0").withColumn("kind", kind).where("kind is not null").select("kind", "pos", "ticks", "value")


def spikes(spark: SparkSession, rows: DataFrame, path: str, h: Nev) -> DataFrame:
    """(store, pos, ticks, channel, sort_code, path, offset, count, dtype, scale) of spike packets.

    A store per waveform length; its name has the length only if there are several.
    """
    room = h.packet_bytes - h.stamp_bytes - 4
    waves = [(i, 2 if h.all_int16 else b, (152592.547 if d == 21516 else float(d)) * 1e-9, w or room // (2 if h.all_int16 else b)) for i, (d, b, w) in h.waves.items()]
    table = spark.createDataFrame(waves, "id int, size int, scale double, count int")
    found = rows.where("id between 1 and 2048").join(F.broadcast(table), "id")
    widths = {w[3] for w in waves}
    store = F.concat(F.lit("spikes_"), F.col("count").cast("string")) if len(widths) > 1 else F.lit("spikes")
    dtype = F.when(F.col("size") == 1, "<i1").when(F.col("size") == 4, "<i4").otherwise("<i2")
    return found.select(store.alias("store"), "pos", "ticks", F.col("id").alias("channel"), F.col("reason").alias("sort_code"), F.lit(path).alias("path"), (F.col("offset") + h.stamp_bytes + 4).alias("offset"), "count", dtype.alias("dtype"), "scale")
