"""Zarr v3 stores as a transactional sink: declared groups and arrays, chunks written by tasks, one commit.

A store is described by a `Layout` (groups, streamed arrays, small arrays) and filled with rows (array, chunk, data). The data
source "zarr" writes them below a staging folder beside the store: a task writes each chunk under a name of its attempt and moves
it to its place when it is whole, so a lost or repeated attempt leaves nothing that counts. Only the commit writes the metadata,
drops what attempts left and renames the folder to the store's name; an abort (failure, cancellation) removes the folder. So a
store under its name is complete, and a store that stood there stays until the new one is.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from spoolwave.sources.files import file_system

#: Rows of a chunk unless stated: about 10 MB of float32.
CHUNK_BYTES = 10_000_000
#: Tasks of a read at most; each reads its chunks one after another.
MOST_TASKS = 10_000
#: Bytes behind one task, and what a file counts for at least: small chunks share a task.
TASK_BYTES = 32 << 20
FILE_BYTES = 32 << 10
#: Bytes of chunks that are laid out, or read, as one batch.
BATCH_BYTES = 4 << 20
#: Chunks of a batch at most.
BATCH_CHUNKS = 256
#: Number types of an array.
TYPES = ("int8", "int16", "uint16", "int32", "int64", "uint64", "float32", "float64")
ROWS = "array string, chunk bigint, data binary"


def chunk_rows(channels: int, rate: float | None = None, seconds: float | None = None) -> int:
    """Rows of a chunk: a stretch of seconds, else about 10 MB."""
    if seconds and rate:
        return max(1, int(seconds * rate))
    return max(1, CHUNK_BYTES // (4 * max(channels, 1)))


# layout


@dataclass
class Layout:
    """What a store holds (K01): groups with attributes, arrays that rows are streamed into, and small arrays given whole."""

    nodes: dict[str, dict] = field(default_factory=dict)
    small: dict[str, list] = field(default_factory=dict)
    level: int | None = 1

    def group(self, path: str, **attrs) -> Layout:
        self.nodes[path] = {"zarr_format": 3, "node_type": "group", "attributes": attrs}
        return self

    def stream(self, path: str, shape: list[int], rows: int, dtype: str, dims: list[str], fill=None, **attrs) -> Layout:
        """An array of this shape whose rows (first dimension) come in chunks of `rows`."""
        if dtype not in TYPES:
            raise ValueError(f"arrays of type {dtype} are not written")
        chunk = [max(1, min(rows, max(shape[0], 1))), *[max(1, s) for s in shape[1:]]] if shape else []
        return self._array(path, shape, chunk, dtype, fill_of(dtype) if fill is None else fill, [{"name": "bytes", "configuration": {"endian": "little"}}], dims, attrs)

    def numbers(self, path: str, values: list, dtype: str, dim: str | None = None, **attrs) -> Layout:
        """A small array, or a scalar if no dimension is named; written by the commit."""
        self.small[path] = list(values)
        return self.stream(path, [len(values)] if dim else [], max(1, len(values)), dtype, [dim] if dim else [], fill=0, **attrs)

    def strings(self, path: str, values: list[str], dim: str | None = None, **attrs) -> Layout:
        self.small[path] = list(values)
        return self._array(path, [len(values)] if dim else [], [max(1, len(values))] if dim else [], "string", "", [{"name": "vlen-utf8"}], [dim] if dim else [], attrs)

    def _array(self, path: str, shape: list[int], chunk: list[int], dtype: str, fill, codecs: list[dict], dims: list[str], attrs: dict) -> Layout:
        if self.level is not None:
            codecs = [*codecs, {"name": "gzip", "configuration": {"level": self.level}}]
        self.nodes[path] = {
            "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "fill_value": "NaN" if fill != fill else fill, "dimension_names": dims,
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
            "codecs": codecs, "attributes": {"_DTYPE": "str" if dtype == "string" else dtype, "_ARRAY_DIMENSIONS": dims, **attrs},
        }
        return self

    def pack(self, data: bytes) -> bytes:
        return data if self.level is None else gzip.compress(data, self.level, mtime=0)

    def small_bytes(self, path: str) -> bytes:
        values, kind = self.small[path], self.nodes[path]["data_type"]
        if kind == "string":
            said = [v.encode() for v in values]
            return struct.pack("<I", len(said)) + b"".join(struct.pack("<I", len(v)) + v for v in said)
        return np.array(values, np.dtype(kind).newbyteorder("<")).tobytes()


def fill_of(dtype: str) -> float | int:
    """What stands where no value was written: NaN, or 0 for whole numbers."""
    return float("nan") if dtype.startswith("float") else 0


def chunk_key(k: int, dims: int) -> str:
    return "/".join(["c", *([str(k), *["0"] * (dims - 1)] if dims else [])])


# data source


@dataclass
class Chunks(WriterCommitMessage):
    written: int
    bytes: int


class StoreWriter(DataSourceArrowWriter):
    """The sink of rows (array, chunk, data): see the module."""

    def __init__(self, path: str, overwrite: bool, layout: Layout) -> None:
        fs, base = file_system(path)
        if not overwrite and fs.get_file_info(base).type != pafs.FileType.NotFound:
            raise FileExistsError(path)
        self.path, self.layout = path, layout
        self.staging = f"{base.rstrip('/')}.writing-{uuid.uuid4().hex}"
        self.dims = {p.strip("/"): len(n["shape"]) for p, n in layout.nodes.items() if n["node_type"] == "array"}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Chunks:
        fs, _ = file_system(self.path)
        own, n, size = f"{self.staging}/_attempts/{uuid.uuid4().hex}", 0, 0
        fs.create_dir(own, recursive=True)
        for batch in iterator:
            for array, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("array", "chunk", "data"))):
                at = f"{self.staging}/{array.strip('/')}/{chunk_key(chunk, self.dims[array.strip('/')])}"
                packed = self.layout.pack(data)
                with fs.open_output_stream(f"{own}/{n}", compression=None) as f:
                    f.write(packed)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                fs.move(f"{own}/{n}", at)
                n, size = n + 1, size + len(packed)
        return Chunks(n, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        fs.create_dir(self.staging, recursive=True)
        for path in self.layout.small:
            self._put(fs, f"{path.strip('/')}/{chunk_key(0, self.dims[path.strip('/')])}", self.layout.pack(self.layout.small_bytes(path)))
        for path, node in sorted({"": {"zarr_format": 3, "node_type": "group", "attributes": {}}, **{p.strip("/"): n for p, n in self.layout.nodes.items()}}.items(), reverse=True):
            self._put(fs, f"{path}/zarr.json".lstrip("/"), json.dumps(node, indent=1).encode())
        if fs.get_file_info(f"{self.staging}/_attempts").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{self.staging}/_attempts")
        there = fs.get_file_info(base).type != pafs.FileType.NotFound
        if there:
            fs.move(base, f"{self.staging}.old")
        fs.move(self.staging, base)
        if there:
            fs.delete_dir(f"{self.staging}.old")

    def _put(self, fs: pafs.FileSystem, name: str, data: bytes) -> None:
        at = f"{self.staging}/{name}"
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at, compression=None) as f:
            f.write(data)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = file_system(self.path)
        if fs.get_file_info(self.staging).type != pafs.FileType.NotFound:
            fs.delete_dir(self.staging)


class StoreSource(DataSource):
    """format("zarr"), write only: options path, layout (JSON); mode overwrite replaces a store when the new one is whole."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], overwrite, Layout(**json.loads(self.options["layout"])))


def write_chunks(rows: DataFrame, path: str, layout: Layout, overwrite: bool = False) -> None:
    """Write (array, chunk, data): row-major little-endian bytes of whole chunks of the layout's streamed arrays."""
    rows.sparkSession.dataSource.register(StoreSource)
    said = json.dumps({"nodes": layout.nodes, "small": layout.small, "level": layout.level})
    rows.select("array", "chunk", "data").write.format("zarr").option("layout", said).mode("overwrite" if overwrite else "append").save(path)


# sampled recordings


def sampled_layout(sizes: list[tuple[str, int, list[int]]], rows: int, dtype: str = "float32", level: int | None = 1) -> Layout:
    """One [time, channel] array for each (recording, samples, channels)."""
    layout = Layout(level=level).group("", recordings=sorted(s[0] for s in sizes))
    for name, n, channels in sizes:
        layout.stream(name, [n, len(channels)], rows, dtype, ["time", "channel"], channels=channels)
    return layout


def as_chunks(chunks: DataFrame, sizes: list[tuple[str, int, list[int]]], rows: int, dtype: str = "float32") -> DataFrame:
    """(array, chunk, data) of (recording, channel, first, values): values dealt to the arrays' chunks, whatever the chunks of the
    source were. A number that the type does not hold exactly stops the job (whole numbers only)."""
    ends = F.sequence(F.floor(F.col("first") / rows), F.floor((F.col("first") + F.size("values") - 1) / rows))
    cut = chunks.where(F.size("values") > 0).select("recording", "channel", "first", "values", F.explode(ends).alias("block"))
    low = F.greatest(F.col("first"), F.col("block") * rows)
    high = F.least(F.col("first") + F.size("values"), (F.col("block") + 1) * rows)
    cut = cut.select("recording", "block", "channel", (low - F.col("block") * rows).alias("at"), F.slice("values", (low - F.col("first") + 1).cast("int"), (high - low).cast("int")).alias("values"))
    shapes = {name: (max(1, min(rows, n)), {c: i for i, c in enumerate(channels)}) for name, n, channels in sizes}
    # small chunks that follow each other are laid out together
    cells = max((height * max(len(places), 1) for height, places in shapes.values()), default=1)
    run = max(1, min(BATCH_CHUNKS, BATCH_BYTES // (8 * cells)))

    def lay(t: pa.Table) -> pa.Table:
        recording, kind = t.column("recording")[0].as_py(), np.dtype(dtype).newbyteorder("<")
        height, places = shapes[recording]
        parts = t.column("values").combine_chunks()
        flat, stops = parts.flatten().to_numpy(zero_copy_only=False), np.cumsum(parts.value_lengths().to_numpy())
        laid: dict[int, np.ndarray] = {}
        for block, c, at, stop, n in zip(t.column("block").to_pylist(), t.column("channel").to_pylist(), t.column("at").to_pylist(), stops.tolist(), np.diff(stops, prepend=0).tolist()):
            if block not in laid:
                laid[block] = np.full((height, len(places)), fill_of(dtype), kind)
            own, data = flat[stop - n : stop], laid[block]
            data[at : at + n, places[c]] = own
            if kind.kind in "iu" and not (data[at : at + n, places[c]] == own).all():
                raise ValueError(f"{recording}, channel {c}: a value is no {dtype}")
        return pa.table({"array": [recording] * len(laid), "chunk": pa.array(list(laid), pa.int64()), "data": pa.array([d.tobytes() for d in laid.values()], pa.binary())})

    return cut.groupBy("recording", F.floor(F.col("block") / run).alias("run")).applyInArrow(lay, ROWS)


def write(chunks: DataFrame, path: str, rows: int = 65536, level: int | None = 1, overwrite: bool = False, dtype: str = "float32") -> DataFrame:
    """Write (recording, channel, first, values) and return (recording, samples, channels); a store that exists is an error unless
    overwrite. Samples without a value are the fill value of the type (NaN or 0)."""
    fs, base = file_system(path)
    if not overwrite and fs.get_file_info(base).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    found = chunks.groupBy("recording").agg(F.max(F.col("first") + F.size("values")).alias("samples"), F.array_sort(F.collect_set("channel")).alias("channels"))
    sizes = [(r.recording, r.samples, list(r.channels)) for r in found.collect()]  # a row per array
    write_chunks(as_chunks(chunks, sizes, rows, dtype), path, sampled_layout(sizes, rows, dtype, level), overwrite)
    return chunks.sparkSession.createDataFrame([(name, n, len(c)) for name, n, c in sizes], "recording string, samples bigint, channels int")


def node(path: str) -> dict:
    """Metadata of a group or an array; a store that was not committed has none."""
    fs, base = file_system(path)
    with fs.open_input_stream(f"{base}/zarr.json") as f:
        return json.loads(f.read())


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(recording, block, first, rows, samples, channels, dtype, fill) of every chunk of a store; nothing but metadata is read."""
    todo = []
    for name in node(path)["attributes"]["recordings"]:
        meta = node(f"{path}/{name}")
        if meta["shape"][0]:
            todo.append((name, meta["shape"][0], meta["attributes"]["channels"], meta["chunk_grid"]["configuration"]["chunk_shape"][0], meta["data_type"], float(meta["fill_value"]), any(c["name"] == "gzip" for c in meta["codecs"])))
    # a row per array on the driver; chunks are told apart by the executors
    arrays = spark.createDataFrame(todo, "recording string, total bigint, channels array<int>, rows bigint, dtype string, fill double, packed boolean")
    each = arrays.withColumn("block", F.explode(F.expr("sequence(0L, (total - 1) div rows)")))
    work = sum(-(-t[1] // t[3]) * max(FILE_BYTES, t[3] * max(len(t[2]), 1) * np.dtype(t[4]).itemsize) for t in todo)
    tasks = max(1, min(sum(-(-t[1] // t[3]) for t in todo), max(spark.sparkContext.defaultParallelism, -(-work // TASK_BYTES)), MOST_TASKS))
    return each.select("recording", "block", (F.col("block") * F.col("rows")).alias("first"), "rows", F.least(F.col("rows"), F.col("total") - F.col("block") * F.col("rows")).alias("samples"), "channels", "dtype", "fill", "packed").repartition(tasks, "recording", "block")


def read(spark: SparkSession, path: str, only: DataFrame | None = None, values: str = "float") -> DataFrame:
    """(recording, channel, first, values) of a store; `only` (recording, block) names the chunks to read, no other file is opened.

    values is the type they come in (float, double or bigint). A chunk that was never written holds the fill value.
    """
    plan = blocks(spark, path)
    if only is not None:
        plan = plan.join(only.select("recording", "block"), ["recording", "block"], "left_semi")
    arrow = {"float": pa.float32(), "double": pa.float64(), "bigint": pa.int64()}[values]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                kind, k = np.dtype(r["dtype"]).newbyteorder("<"), len(r["channels"])
                try:
                    with fs.open_input_stream(f"{root}/{r['recording']}/{chunk_key(r['block'], 2)}", compression=None) as f:
                        raw = f.read()
                    data = np.frombuffer(gzip.decompress(raw) if r["packed"] else raw, kind).reshape(r["rows"], k)[: r["samples"]]
                except FileNotFoundError:
                    data = np.full((r["samples"], k), r["fill"], kind)
                data = data.astype(arrow.to_pandas_dtype())
                held.append((r["recording"], r["channels"], r["first"], data))
                size += data.nbytes
                if size >= BATCH_BYTES or len(held) == BATCH_CHUNKS:
                    yield joined(held)
                    held, size = [], 0
        if held:
            yield joined(held)

    def joined(held: list[tuple]) -> pa.RecordBatch:
        each = [len(channels) for _, channels, _, _ in held]
        values = [np.ascontiguousarray(data[:, i]) for _, _, _, data in held for i in range(data.shape[1])]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h, k in zip(held, each) for _ in range(k)], pa.string()), pa.array([c for h in held for c in h[1]], pa.int32()), pa.array([h[2] for h, k in zip(held, each) for _ in range(k)], pa.int64()), pa.array(values, pa.list_(arrow))],
            names=["recording", "channel", "first", "values"],
        )

    return plan.select("recording", "block", "first", "rows", "samples", "channels", "dtype", "fill", "packed").mapInArrow(load, f"recording string, channel int, first bigint, values array<{values}>")


def stored_bytes(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """(recording, block, bytes) of the chunk files that stand in a store, or of those that `only` names; listed by the executors."""
    plan = blocks(spark, path).select("recording", "block")
    if only is not None:
        plan = plan.join(only.select("recording", "block"), ["recording", "block"], "left_semi")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            names = [f"{root}/{r}/{chunk_key(b, 2)}" for r, b in zip(batch.column("recording").to_pylist(), batch.column("block").to_pylist())]
            sizes = [i.size or 0 for i in fs.get_file_info(names)]
            yield pa.RecordBatch.from_arrays([batch.column("recording"), batch.column("block"), pa.array(sizes, pa.int64())], names=["recording", "block", "bytes"])

    return plan.mapInArrow(look, "recording string, block bigint, bytes bigint")
