"""Readers by format, and detection by confidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from spoolwave.sources.files import file_system
from spoolwave.sources.recordings import HEADER, Header, RecordingSource
from spoolwave.sources.records import FORMATS, RecordSource


@dataclass
class Reader:
    """A source: its Spark format, what it claims of a path (0 to 1), and options for the load."""

    name: str
    source: type[DataSource]
    detect: Callable[[str], float]
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Registry:
    readers: list[Reader] = field(default_factory=list)

    def with_reader(self, reader: Reader) -> Registry:
        return Registry([*self.readers, reader])

    def detect(self, path: str) -> list[tuple[str, float]]:
        """(reader, confidence) of all that claim the path, best first, earlier readers first among equals."""
        claims = [(r.name, r.detect(path)) for r in self.readers]
        return sorted((c for c in claims if c[1] > 0), key=lambda c: -c[1])

    def open(self, spark: SparkSession, path: str, **options: str) -> DataFrame:
        """Load the path by its best claim."""
        found = self.detect(path)
        if not found:
            raise ValueError(f"no reader opens {path}")
        reader = next(r for r in self.readers if r.name == found[0][0])
        spark.dataSource.register(reader.source)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        return spark.read.format(reader.source.name()).options(**reader.options, **options).load(path)


def _is_example(path: str) -> float:
    fs, where = file_system(path)
    if not where.endswith(".example"):
        return 0.0
    with fs.open_input_file(where) as f:
        try:
            Header.parse(f.read(HEADER.size))
        except ValueError:
            return 0.0
    return 0.95


def builtin() -> Registry:
    """The readers that come with the engine."""
    records = [Reader(f, RecordSource, lambda p, s=spec[0]: 0.8 if p.lower().endswith(s) else 0.0, {"format": f}) for f, spec in FORMATS.items()]
    return Registry([Reader("example", RecordingSource, _is_example, {"layout": "example"}), *records])
