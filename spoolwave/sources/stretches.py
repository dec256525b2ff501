"""Stretches: one description of where samples lie, for every binary layout.

A stretch is a run of samples at a fixed step in one file. Its rows are a table, so planning a recording is a DataFrame
program (a header parsed on the driver, or an index file read by executors), and reading is one mapInArrow over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolwave.sources.files import file_system

SCHEMA = "recording string, path string, first bigint, samples bigint, offset bigint, dtype string, step bigint, places array<bigint>, channels array<int>, gains array<double>, shifts array<double>"
CHUNKS = "recording string, channel int, first bigint, values array<float>"
#: Samples of a stretch at most; longer ones are split, which makes the read tasks.
SPLIT = 1 << 18


def stretch(recording: str, path: str, samples: int, offset: int, dtype: str, step: int, places: list[int], channels: list[int] | None = None, gains: list[float] | None = None, shifts: list[float] | None = None, first: int = 0) -> tuple:
    """A row of SCHEMA. value = raw * gain + shift; places are the channels' bytes after the stretch's first one."""
    n = len(places)
    return (recording, path, first, samples, offset, dtype, step, places, channels or list(range(n)), gains or [1.0] * n, shifts or [0.0] * n)


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def split(stretches: DataFrame, most: int = SPLIT) -> DataFrame:
    """Stretches of at most `most` samples, spread over tasks."""
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("samples") / most) - 1, F.lit(0))))
    rows = stretches.where("samples > 0").withColumn("_k", part)
    at = F.col("_k") * most
    return (
        rows.withColumn("first", F.col("first") + at)
        .withColumn("offset", F.col("offset") + at * F.col("step"))
        .withColumn("samples", F.least(F.lit(most), F.col("samples") - at))
        .drop("_k")
        .repartition("recording", "path", "offset")
    )


def wanted(stretches: DataFrame, start: int = 0, end: int | None = None, only: list[str] | None = None, channels: list[int] | None = None) -> DataFrame:
    """Stretches cut to a sample range, recordings and channels, before any byte is read."""
    rows = stretches if only is None else stretches.where(F.col("recording").isin(only))
    low = F.greatest(F.col("first"), F.lit(start))
    high = F.col("first") + F.col("samples")
    high = high if end is None else F.least(high, F.lit(end))
    rows = rows.withColumn("_low", low).withColumn("_n", high - low).where("_n > 0")
    rows = rows.withColumn("offset", F.col("offset") + (F.col("_low") - F.col("first")) * F.col("step")).withColumn("first", F.col("_low")).withColumn("samples", F.col("_n")).drop("_low", "_n")
    if channels is not None:
        keep: Column = F.filter(F.sequence(F.lit(0), F.size("channels") - 1), lambda i: F.get("channels", i).isin(channels))
        rows = rows.withColumn("_keep", F.when(F.size("channels") > 0, keep).otherwise(F.array().cast("array<int>"))).where(F.size("_keep") > 0)
        for c in ("places", "gains", "shifts", "channels"):
            rows = rows.withColumn(c, F.expr(f"transform(_keep, i -> get({c}, i))"))
        rows = rows.drop("_keep")
    return rows


def read(stretches: DataFrame, scaled: bool = True) -> DataFrame:
    """(recording, channel, first, values): a chunk of each channel of each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = np.dtype(r["dtype"])
                fs, path = file_system(r["path"])
                span = (r["samples"] - 1) * r["step"] + max(r["places"]) + kind.itemsize
                with fs.open_input_file(path) as f:
                    raw = f.read_at(span, r["offset"])
                if len(raw) < span:
                    raise EOFError(f"{path} ends inside a stretch at byte {r['offset']}")
                chunks = []
                for place, gain, shift in zip(r["places"], r["gains"], r["shifts"]):
                    v = np.ndarray((r["samples"],), kind, raw, place, (r["step"],)).astype(np.float64)
                    chunks.append((v * gain + shift if scaled else v).astype(np.float32))
                n = len(chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["recording"]] * n), pa.array(r["channels"], pa.int32()), pa.array([r["first"]] * n, pa.int64()), pa.array(chunks, pa.list_(pa.float32()))],
                    names=["recording", "channel", "first", "values"],
                )

    return split(stretches).mapInArrow(run, CHUNKS)


def samples(chunks: DataFrame) -> DataFrame:
    """(recording, channel, sample, value) of chunks."""
    return chunks.select("recording", "channel", "first", F.posexplode("values").alias("_i", "value")).select("recording", "channel", (F.col("first") + F.col("_i")).alias("sample"), "value")


def payloads(index: DataFrame, keys: list[str], path: str = "path", offset: str = "offset", count: str = "count", dtype: str = "dtype", scale: str | None = None) -> DataFrame:
    """(keys, waveform): values at places that an index names, read only where the waveform is used."""
    types = dict(index.dtypes)
    cols = index.select(*keys, F.col(path).alias("_path"), F.col(offset).cast("bigint").alias("_offset"), F.col(count).cast("int").alias("_count"), F.col(dtype).alias("_dtype"), (F.col(scale) if scale else F.lit(1.0)).cast("double").alias("_scale"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            out = []
            for p, o, n, d, s in zip(*(batch.column(c).to_pylist() for c in ("_path", "_offset", "_count", "_dtype", "_scale"))):
                if p not in files:
                    fs, where = file_system(p)
                    files[p] = fs.open_input_file(where)
                kind = np.dtype(d)
                out.append((np.frombuffer(files[p].read_at(n * kind.itemsize, o), kind).astype(np.float64) * s).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, pa.list_(pa.float32()))], names=[*keys, "waveform"])

    return cols.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", waveform array<float>")
