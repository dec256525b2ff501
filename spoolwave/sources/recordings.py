"""Interleaved int16 recordings as a Spark data source, read and write.

Format "recording", layouts by option `layout`:
  example      *.example files: 32-byte header (EXAMPLE1, uint32 channels, float64 rate, float64 volts per bit, uint32
               reserved), then int16 samples, channels interleaved. Several files are parts in name order.
  interleaved  headerless int16 files (options suffix, saved = number of channels, rate, gain)
Options: channels = "3,0,7" (subset, order kept), start and end (sample range), scaled = true for volts, strict = true to refuse a
range that ends behind the last sample (while the source is planned, before a job runs).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from spoolwave.sources.files import file_system, listing

MAGIC = b"EXAMPLE1"
HEADER = struct.Struct("<8sIddI")
#: Samples in a read task at most, and values in a batch.
STRETCH = 1 << 20
BATCH_VALUES = 1 << 20


class SampleRange(ValueError):
    """A range that ends before it starts, or behind the last sample."""


class NoChannel(ValueError):
    """A channel that the recording does not have."""


def refusal(start: Column, end: Column, channels: Column, total: Column, samples: Column) -> Column:
    """Why a request is refused: `sample range` before `channel`, null if it can be read."""
    wrong = F.exists(channels, lambda c: c.isNull() | (c < 0) | (c >= total))
    return F.when((start < 0) | (start > end) | (end > samples), "sample range").when(wrong, "channel")


def check_requests(requests: DataFrame, total: Column, samples: Column) -> DataFrame:
    """requests (start, end, channels) with `refused` and `samples`, the samples a channel gives (null if refused)."""
    told = requests.withColumn("refused", refusal(F.col("start"), F.col("end"), F.col("channels"), total, samples))
    return told.withColumn("samples", F.when(F.col("refused").isNull(), F.col("end") - F.col("start")))


@dataclass
class Header:
    channels: int
    rate: float
    volts_per_bit: float

    @classmethod
    def parse(cls, raw: bytes) -> Header:
        if len(raw) < HEADER.size or raw[:8] != MAGIC:
            raise ValueError("not an EXAMPLE1 file")
        _, channels, rate, volts, _ = HEADER.unpack(raw[: HEADER.size])
        if channels == 0 or not rate > 0:
            raise ValueError(f"bad header: {channels} channels at {rate} Hz")
        return cls(channels, rate, volts)

    def bytes(self) -> bytes:
        return HEADER.pack(MAGIC, self.channels, self.rate, self.volts_per_bit, 0)


@dataclass
class Part(InputPartition):
    path: str
    first: int  # sample number of the file's first sample
    start: int  # range within the file
    end: int
    skip: int  # header bytes
    channels: int
    gain: float


class RecordingReader(DataSourceReader):
    """Plans sample ranges of the files that the wanted range touches; reads only those bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.layout = options.get("layout", "example")
        self.options = options
        self.start, self.end = int(options.get("start", 0)), int(options["end"]) if "end" in options else None
        self.wanted = [int(c) for c in options["channels"].split(",")] if options.get("channels") else None
        self.scaled = options.get("scaled", "false").lower() == "true"
        if self.layout not in ("example", "interleaved"):
            raise ValueError(f"unknown layout {self.layout}")
        if self.start < 0 or (self.end is not None and self.end < self.start):
            raise SampleRange(f"samples {self.start}..{self.end}")
        self.strict = self.options.get("strict", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("sample",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = int(f.value)
                low = v + isinstance(f, GreaterThan) if not isinstance(f, (LessThan, LessThanOrEqual)) else None
                high = v + (not isinstance(f, LessThan)) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else None
                self.start = max(self.start, low) if low is not None else self.start
                self.end = high if high is not None and (self.end is None or high < self.end) else self.end
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, files = listing(self.path, self.options.get("suffix", ".example" if self.layout == "example" else ".bin"))
        out, first = [], 0
        for info in files:
            if self.layout == "example":
                with fs.open_input_file(info.path) as f:
                    head = Header.parse(f.read(HEADER.size))
                skip, channels, gain = HEADER.size, head.channels, head.volts_per_bit
            else:
                skip, channels, gain = int(self.options.get("skip", 0)), int(self.options["saved"]), float(self.options.get("gain", 1.0))
            if self.wanted and (bad := [c for c in self.wanted if not 0 <= c < channels]):
                raise NoChannel(f"channels {bad} of {channels}")
            samples = (info.size - skip) // (2 * channels)
            lo, hi = max(self.start - first, 0), min(samples, (self.end if self.end is not None else first + samples) - first)
            out += [Part(info.path, first, a, min(a + STRETCH, hi), skip, channels, gain) for a in range(lo, hi, STRETCH)]
            first += samples
        if self.strict and self.end is not None and self.end > first:
            raise SampleRange(f"samples {self.start}..{self.end} of {first}")
        return out or [Part("", 0, 0, 0, 0, 1, 1.0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = file_system(self.path)
        pick = self.wanted or list(range(part.channels))
        step = max(1, BATCH_VALUES // part.channels)
        with fs.open_input_file(part.path) as f:
            for a in range(part.start, part.end, step):
                n = min(step, part.end - a)
                raw = np.frombuffer(f.read_at(n * 2 * part.channels, part.skip + a * 2 * part.channels), "<i2").reshape(n, part.channels)[:, pick]
                values = (raw * part.gain).astype(np.float32) if self.scaled else raw.astype(np.float32)
                rows = pa.ListArray.from_arrays(np.arange(0, n * len(pick) + 1, len(pick), dtype=np.int32), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + a, part.first + a + n)), rows], names=["sample", "values"])


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class RecordingWriter(DataSourceArrowWriter):
    """Writes rows (sample, values) as example files; a task's rows must be in order. Files get their names at commit, so that
    what a failed attempt left has none that a reader looks for."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.rate, self.volts = float(options.get("rate", 1.0)), float(options.get("volts_per_bit", 1.0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        out, names = None, []
        for batch in iterator:
            samples = batch.column("sample").to_numpy()
            values = batch.column("values")
            if not len(samples):
                continue
            raw = np.rint(values.flatten().to_numpy(zero_copy_only=False)).clip(-32768, 32767).astype("<i2")
            if out is None:
                names.append(f"{base}/part-{samples[0]:020d}-{uuid.uuid4().hex}.writing")
                out = fs.open_output_stream(names[-1], compression=None)
                out.write(Header(len(raw) // len(samples), self.rate, self.volts).bytes())
            out.write(raw.tobytes())
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(name, name.removesuffix(".writing") + ".example")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(name)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return "sample bigint, values array<float>"

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(dict(self.options))
