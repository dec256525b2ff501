"""Fixed-size record files as a Spark data source.

Format "records", option `format` names a layout below, or `custom` one that the options state: `fields` (JSON: name, number type
and shape of each field, at most two dimensions), `suffix` and `skip` (bytes of the file's head). Rows have `k` (record number in
the file), `file` and the layout's fields, or those that the option `columns` names; a read task is a range of records of one file
(option `splitBytes`; more than MOST_TASKS ranges of it grow together, up to STRETCH_BYTES).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from spoolwave.sources.files import file_system, listing

#: Suffix, header bytes and record layout of the formats.
FORMATS: dict[str, tuple[str, int, list[tuple]]] = {
    "tsq": (".tsq", 0, [("size", "<i4"), ("type", "<i4"), ("name", "S4"), ("chan", "<u2"), ("sortcode", "<u2"), ("timestamp", "<f8"), ("offset", "<u8"), ("format", "<i4"), ("freq", "<f4")]),
    "ncs": (".ncs", 16384, [("timestamp", "<u8"), ("channel", "<u4"), ("rate", "<u4"), ("valid", "<u4"), ("samples", "<i2", 512)]),
    "nlx_events": (".nev", 16384, [("nstx", "<i2"), ("packet_id", "<i2"), ("data_size", "<i2"), ("timestamp", "<u8"), ("event_id", "<i2"), ("ttl", "<u2"), ("crc", "<i2"), ("dummy1", "<i2"), ("dummy2", "<i2"), ("extra", "<i4", 8), ("text", "S128")]),
    "oe_continuous": (".continuous", 1024, [("timestamp", "<i8"), ("n", "<u2"), ("recording", "<u2"), ("samples", ">i2", 1024), ("marker", "S10")]),
    "words": (".dat", 0, [("word", "<u2")]),
}
STRETCH_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
#: Tasks up to which a stated `splitBytes` holds: each task costs the driver some kB, whatever it reads.
MOST_TASKS = 256
_SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "u8": "bigint", "f4": "float", "f8": "double"}
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass
class RecordLayout:
    """Suffix, head and fields of a record file, and the columns that are wanted."""

    suffix: str
    skip: int
    dtype: np.dtype
    columns: list[str]

    @classmethod
    def of(cls, options: dict[str, str]) -> RecordLayout:
        name = options["format"]
        if name == "custom":
            fields = [(f[0], f[1], *([tuple(f[2])] if len(f) > 2 and f[2] else [])) for f in json.loads(options["fields"])]
            suffix, skip = options.get("suffix", ""), int(options.get("skip", 0))
        elif name in FORMATS:
            suffix, skip, fields = FORMATS[name]
        else:
            raise ValueError(f"unknown format {name}")
        kind = np.dtype(fields)
        columns = [c for c in options["columns"].split(",") if c] if "columns" in options else [n for n in kind.names if kind[n].base.kind != "V"]
        if unknown := [c for c in columns if c not in kind.names]:
            raise ValueError(f"no fields {unknown} among {list(kind.names)}")
        if deep := [c for c in columns if len(kind[c].shape) > 2 or kind[c].base.kind not in "iufS"]:
            raise ValueError(f"fields {deep} are not read: bytes without a type, or more than two dimensions")
        return cls(suffix, skip, kind, columns)

    def spark(self, column: str) -> str:
        base = self.dtype[column].base
        return "string" if base.kind == "S" else _SPARK[base.str.lstrip("<>|=")]

    def schema(self) -> str:
        nested = lambda c: "".join("array<" for _ in self.dtype[c].shape) + self.spark(c) + "".join(">" for _ in self.dtype[c].shape)
        return ", ".join(["file string", "k bigint", *[f"`{c}` {nested(c)}" for c in self.columns]])

    def arrow(self, column: str, v: np.ndarray) -> pa.Array:
        """A column of records as Arrow: a field with a shape becomes (nested) lists."""
        spark, shape = self.spark(column), self.dtype[column].shape
        if spark == "string":
            return pa.array([x.split(b"\0")[0].decode("latin-1") for x in v.tolist()])
        flat = np.ascontiguousarray(v).ravel()
        out = pa.array(flat.astype(flat.dtype.newbyteorder("=")).astype(_ARROW[spark].to_pandas_dtype()), _ARROW[spark])
        for size in reversed(shape):
            out = pa.ListArray.from_arrays(np.arange(0, len(out) + 1, size, dtype=np.int32), out)
        return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.layout = options["path"], RecordLayout.of(options)
        self.stretch = int(options.get("splitBytes", STRETCH_BYTES))

    def partitions(self) -> list[Range]:
        skip, size = self.layout.skip, self.layout.dtype.itemsize
        _, files = listing(self.path, self.layout.suffix)
        least = min(STRETCH_BYTES, -(-sum(max(i.size - skip, 0) for i in files) // MOST_TASKS))
        step = max(1, self.stretch // size, -(-least // size))
        # a partial record at the end of a file is left out
        return [Range(i.path, a, min(a + step, (i.size - skip) // size)) for i in files for a in range(0, max((i.size - skip) // size, 0), step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        layout, fs = self.layout, file_system(self.path)[0]
        size = layout.dtype.itemsize
        step = max(1, BATCH_BYTES // size)
        name = part.path.rsplit("/", 1)[-1]
        with fs.open_input_file(part.path) as f:
            for a in range(part.start, part.end, step):
                n = min(step, part.end - a)
                rows = np.frombuffer(f.read_at(n * size, layout.skip + a * size), layout.dtype)
                cols = [pa.array([name] * n), pa.array(np.arange(a, a + n)), *[layout.arrow(c, rows[c]) for c in layout.columns]]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "k", *layout.columns])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RecordLayout.of(self.options).schema()

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options)


def shaped(spark: SparkSession, path: str, fields: list[tuple], skip: int = 0, suffix: str = "", columns: list[str] | None = None, split_bytes: int = STRETCH_BYTES) -> DataFrame:
    """Records of stated fields (name, number type[, shape]) behind `skip` bytes; only the wanted columns leave the reader."""
    spark.dataSource.register(RecordSource)
    options = {"format": "custom", "fields": json.dumps([[f[0], f[1], list(f[2]) if len(f) > 2 else []] for f in fields]), "skip": str(skip), "suffix": suffix, "splitBytes": str(split_bytes)}
    if columns is not None:
        options["columns"] = ",".join(columns)
    return spark.read.format("records").options(**options).load(path)


def write_records(records: np.ndarray, uri: str, fmt: str, header: bytes = b"") -> None:
    """Write records of a layout to one file, its header padded to the layout's size; for fixtures and exports of small tables."""
    _, skip, fields = FORMATS[fmt]
    if records.dtype != np.dtype(fields):
        raise ValueError("records do not have the layout's fields")
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(header.ljust(skip, b"\0")[:skip] + records.tobytes())
