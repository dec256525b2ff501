"""Record files with a text header."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolwave.operators import sections
from spoolwave.sources.files import file_system
from spoolwave.sources.records import RecordSource, shaped

HEADER, BLOCK = 16384, 512


def header(raw: bytes) -> dict[str, str]:
    """-Key value lines of the first 16 KiB; the first value of a repeated key counts."""
    out: dict[str, str] = {}
    for line in raw[:HEADER].split(b"\0")[0].decode("latin-1").splitlines():
        if m := re.match(r"\s*-(\S+)\s*(.*?)\s*$", line):
            out.setdefault(m[1], m[2].strip('"'))
    return out


def volts_per_bit(h: dict[str, str], channels: int = 1) -> list[float]:
    """Gain per channel, its sign turned for inverted input; one value stands for all."""
    words = [float(x) for x in h.get("ADBitVolts", "1").split()]
    sign = -1.0 if h.get("InputInverted", "").lower() == "true" else 1.0
    return [w * sign for w in (words * channels if len(words) == 1 else words)]


def acquisition(h: dict[str, str]) -> str:
    """pre4, stated or measured: how far the rate and time stamps can be trusted."""
    if re.search(r"(?i)digitallynxsx|cheetah64|atlas", h.get("HardwareSubSystemType", "") + h.get("AcquisitionSystem", "")):
        return "stated" if re.search(r"(?i)atlas|sx", h.get("HardwareSubSystemType", "") + h.get("AcquisitionSystem", "")) else "pre4"
    return "pre4" if "CheetahRev" in h and h["CheetahRev"].split(".")[0] in "1234" else "measured"


def stream_key(h: dict[str, str]) -> str:
    """Files of one rate, range and filter belong to one stream (P20)."""
    keys = ("SamplingFrequency", "InputRange", "DspLowCutFilterEnabled", "DspLowCutFrequency", "DspLowCutNumTaps", "DspLowCutFilterType", "DspHighCutFilterEnabled", "DspHighCutFrequency", "DspHighCutNumTaps", "DspHighCutFilterType", "DspDelayCompensation")
    return "|".join(h.get(k, "") for k in keys)


def application(h: dict[str, str]) -> str | None:
    """Program name from whichever property a version writes."""
    if h.get("ApplicationName"):
        return h["ApplicationName"]
    return f"Cheetah {h['CheetahRev']}" if h.get("CheetahRev") else None


def opened(h: dict[str, str]) -> tuple[str, str] | None:
    """Date and time of recording, m/d/y or y/m/d."""
    m = re.search(r"(\d+)/(\d+)/(\d+)\s+.*?(\d+:\d+:\d+)", h.get("TimeCreated", h.get("TimeOpened", "")))
    if not m:
        return None
    a, b, c = m[1], m[2], m[3]
    y, mo, d = (a, b, c) if len(a) == 4 else (c, a, b)
    return f"{int(y):04d}-{int(mo):02d}-{int(d):02d}", m[4]


def ncs(spark: SparkSession, path: str) -> DataFrame:
    """Records of signal files."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("format", "ncs").load(path)


def ncs_sections(records: DataFrame, rate: float, tolerance: int = 0) -> DataFrame:
    """(file, section, first, last, start, samples).

    A file whose last record lies where the first predicts is one section as a whole, whatever its inner steps say; its
    inner records then count as full.
    """
    ends = records.groupBy("file").agg(F.min("k").alias("_a"), F.max("k").alias("_b"), F.min_by("timestamp", "k").alias("_t0"), F.max_by("timestamp", "k").alias("_t1"), F.max_by("valid", "k").alias("_v1"), F.count_distinct("channel", "rate").alias("_kinds"))
    whole = (F.col("_t1") == F.round(F.col("_t0") + 1e6 / rate * BLOCK * (F.col("_b") - F.col("_a"))).cast("bigint")) & (F.col("_kinds") == 1)
    ends = ends.withColumn("_whole", whole)
    one = ends.where("_whole").select("file", F.lit(0).cast("bigint").alias("section"), F.col("_a").alias("first"), F.col("_b").alias("last"), F.col("_t0").alias("start"), (BLOCK * (F.col("_b") - F.col("_a")) + F.col("_v1")).alias("samples"))
    rest = records.join(ends.where("not _whole").select("file"), "file", "left_semi")
    cut = sections.gap_sections(rest, "file", "k", "timestamp", F.col("valid"), F.floor(F.col("valid") / rate * 1e6), F.lit(tolerance))
    return one.unionByName(cut.select(*one.columns))


def ncs_samples(records: DataFrame, gain: float = 1.0) -> DataFrame:
    """(file, sample, value): valid samples of the records, numbered over the file."""
    w = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = records.withColumn("_first", F.coalesce(F.sum("valid").over(w), F.lit(0)))
    long = rows.select("file", "_first", F.posexplode(F.slice("samples", F.lit(1), F.col("valid").cast("int"))).alias("_i", "_v"))
    return long.select("file", (F.col("_first") + F.col("_i")).alias("sample"), (F.col("_v").cast("double") * gain).cast("float").alias("value"))


def spikes(spark: SparkSession, path: str, wires: int, samples: int, gains: list[float], **options) -> DataFrame:
    """(file, k, t_us, cell, wire, waveform): a 48-byte head, then [sample][wire] int16."""
    fields = [("timestamp", "<u8"), ("entity", "<u4"), ("cell", "<u4"), ("features", "<u4", (8,)), ("data", "<i2", (samples, wires))]
    suffix = "." + path.rsplit(".", 1)[1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    rows = shaped(spark, path, fields, HEADER, suffix, ["timestamp", "cell", "data"], **options)
    wire = F.explode(F.sequence(F.lit(0), F.lit(wires - 1))).alias("wire")
    long = rows.select("file", "k", F.col("timestamp").alias("t_us"), F.col("cell").cast("int").alias("cell"), "data", wire)
    g = F.array(*map(F.lit, gains))
    return long.select("file", "k", "t_us", "cell", "wire", F.transform("data", lambda v: (F.get(v, F.col("wire")) * F.get(g, F.col("wire"))).cast("float")).alias("waveform"))


def events(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, ttl, text, t_us) of an event file."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("format", "nlx_events").load(path).select("k", "event_id", "ttl", "text", F.col("timestamp").alias("t_us"))
