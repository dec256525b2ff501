"""WARC archives as a Spark Python data source, and a round trip that stores equal payloads once."""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from spoolwave.llm.common import plain, scratch_path

SCHEMA = (
    "record_type string, record_id string, date string, target_uri string, payload_digest string, payload_bytes bigint, content_length bigint,"
    " page_id bigint, refers_to bigint, payload binary"
)
WRITE_SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload binary"
#: Payloads of fewer bytes are never stored as a revisit.
LEAST_SHARED = 100
#: Tasks over which the pages of one payload are dealt.
SHARES = 32
#: Bytes of an archive file after which the next one begins, and of a stretch that one read task gets.
FILE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
#: Bytes of payload in a batch handed to Spark.
BATCH_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SL = struct.Struct("<4sIBBH2sHII")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def member(record: bytes, level: int = 4) -> bytes:
    """A record as a gzip member of its own, with the 'sl' extra field (compressed and plain size) that lets readers skip it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = _SL.size + len(body) + 8
    return _SL.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"WARC-X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, list[int]]]  # name, bytes, offsets at which a stretch may begin


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own under fresh names; only committed ones enter the manifest, so retries leave no rows."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        files: list[tuple[str, int, list[int]]] = []
        out, name, at, marks = None, "", 0, [0]
        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload"))):
                if out is None:
                    name, at, marks = f"{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(*row))
                out.write(data)
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    files.append((name, at, marks))
                    out = None
                elif at - marks[-1] >= SPLIT_BYTES:
                    marks.append(at)
        if out is not None:
            out.close()
            files.append((name, at, marks))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.files:
                with fs.open_output_stream(f"{base}/_manifest-{uuid.uuid4().hex}.json") as out:
                    out.write(json.dumps(m.files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else ():
                fs.delete_file(f"{base}/{name}")


@dataclass
class Stretch(InputPartition):
    name: str
    start: int
    end: int | None


_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x,
    EqualNullSafe: lambda v, x: v == x,
    GreaterThan: lambda v, x: v is not None and v > x,
    GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x,
    LessThanOrEqual: lambda v, x: v is not None and v <= x,
    In: lambda v, x: v is not None and v in x,
    IsNull: lambda v, _: v is None,
    IsNotNull: lambda v, _: v is not None,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
}
_HEADERS = ("record_type", "record_id", "date", "target_uri", "payload_digest", "content_length", "page_id", "refers_to")


def header_row(head: bytes) -> dict:
    """Columns that follow from a record's header block alone."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    got = {}
    for line in lines[1:]:
        key, _, value = line.partition(":")
        got.setdefault(key.strip().lower(), value.strip())
    number = lambda k: int(got[k]) if k in got else None
    return {
        "record_type": got.get("warc-type"),
        "record_id": got.get("warc-record-id"),
        "date": got.get("warc-date"),
        "target_uri": got.get("warc-target-uri"),
        "payload_digest": got.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "payload_bytes": number("warc-x-payload-length"),
        "content_length": int(got.get("content-length", 0)),
        "page_id": number("warc-x-page-id"),
        "refers_to": number("warc-x-refers-to-page-id"),
        "payload": None,
    }


class WarcReader(DataSourceReader):
    """Plans stretches of files; reads a record's headers first and its payload only if the record is wanted."""

    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.tests = path, payload, []
        self.skipped = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner, wanted = (f.child, False) if isinstance(f, Not) and isinstance(f.child, (IsNull, IsNotNull)) else (f, True)
            name = getattr(inner, "attribute", ())
            if type(inner) in _TESTS and len(name) == 1 and name[0] in _HEADERS:
                self.tests.append((type(inner), name[0], getattr(inner, "value", None), wanted))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        fs, base = _fs(self.path)
        listed = fs.get_file_info(pafs.FileSelector(base))
        manifests = [i for i in listed if i.base_name.startswith("_manifest-")]
        out: list[Stretch] = []
        if manifests:
            for i in sorted(manifests, key=lambda i: i.base_name):
                with fs.open_input_stream(i.path) as f:
                    for name, size, marks in json.loads(f.read()):
                        out += [Stretch(name, a, b) for a, b in zip(marks, [*marks[1:], size])]
        else:
            out = [Stretch(i.base_name, 0, None) for i in sorted(listed, key=lambda i: i.base_name) if i.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Stretch("", 0, 0)]

    def wanted(self, row: dict) -> bool:
        return all(_TESTS[kind](row[name], value) == yes for kind, name, value, yes in self.tests)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, base = _fs(self.path)
        rows, held = [], 0
        with fs.open_input_file(f"{base}/{partition.name}") as raw:
            f = io.BufferedReader(raw, 1 << 20)
            f.seek(partition.start)
            for row in self.records(f, partition):
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def records(self, f: io.BufferedReader, partition: Stretch) -> Iterator[dict]:
        at, end = partition.start, partition.end
        while end is None or at < end:
            magic = f.read(_SL.size)
            f.seek(at)  # within the buffer
            if not magic:
                return
            if magic[:2] != b"\x1f\x8b":
                at, row = self._plain(f, at)
            elif len(magic) == _SL.size and magic[3] == 4 and magic[12:14] == b"sl":
                at, row = self._skippable(f, at, _SL.unpack(magic)[7])
            else:
                at, row = self._member(f, at)
            if row is not None:
                yield row

    def _skippable(self, f: io.BufferedReader, at: int, size: int) -> tuple[int, dict | None]:
        first = f.read(min(size, 2048))
        z = zlib.decompressobj(-15)
        plain, fed = z.decompress(first[_SL.size :]), len(first)
        while (cut := plain.find(b"\r\n\r\n")) < 0 and fed < size:
            more = f.read(min(size - fed, 1 << 16))
            fed += len(more)
            plain += z.decompress(more)
        row = header_row(plain[:cut])
        if not self.wanted(row):
            self.skipped += size - fed
            f.seek(at + size)
            return at + size, None
        if self.payload:
            plain += z.decompress(f.read(size - fed)) + z.flush()
            row["payload"] = _payload(row, plain[cut + 4 : cut + 4 + row["content_length"]])
        else:
            f.seek(at + size)
        return at + size, row

    def _member(self, f: io.BufferedReader, at: int) -> tuple[int, dict | None]:
        """A gzip member of unknown length: inflated to the end of the headers, then kept if the record is wanted, else dropped
        piece by piece, since only inflating finds where it ends."""
        z, plain, fed = zlib.decompressobj(31), bytearray(), 0
        row, cut, keep = None, -1, True
        while not z.eof:
            data = f.read(1 << 16)
            if not data:
                raise EOFError("a gzip member ends early")
            fed += len(data)
            piece = z.decompress(data)
            if keep:
                plain += piece
            if cut < 0 and (cut := plain.find(b"\r\n\r\n")) >= 0:
                row = header_row(bytes(plain[:cut]))
                wanted = self.wanted(row)
                keep, row = wanted and self.payload, row if wanted else None
                if not keep:
                    plain.clear()
        if cut < 0:
            raise ValueError("a WARC record without a header end")
        at += fed - len(z.unused_data)
        f.seek(at)
        if row is not None and self.payload:
            row["payload"] = _payload(row, bytes(plain[cut + 4 : cut + 4 + row["content_length"]]))
        return at, row

    def _plain(self, f: io.BufferedReader, at: int) -> tuple[int, dict | None]:
        lines = []
        while (line := f.readline()) not in (b"\r\n", b""):
            lines.append(line)
        row = header_row(b"".join(lines).rstrip(b"\r\n"))
        start = at + sum(map(len, lines)) + 2
        after = start + row["content_length"] + 4
        keep = self.wanted(row)
        if keep and self.payload:
            row["payload"] = _payload(row, f.read(row["content_length"]))
        f.seek(after)
        return after, row if keep else None


def _payload(row: dict, block: bytes) -> bytes | None:
    """The body behind the HTTP headers of a response; other records' blocks as they are, a revisit has none."""
    if row["record_type"] == "revisit":
        return None
    if row["record_type"] == "response" and block.startswith(b"HTTP/"):
        block = block[block.find(b"\r\n\r\n") + 4 :]
    row["payload_bytes"] = len(block)
    return block


_ARROW = pa.schema(
    [("record_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("content_length", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    """format("warc"): option path; option payload=false leaves payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def write_warc(records: DataFrame, path: str) -> None:
    """Write (page_id, url, record_type, refers_to, payload_digest, payload) as archives under path."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload").write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def as_records(pages: DataFrame) -> DataFrame:
    """Records to write: of equal payloads of at least LEAST_SHARED bytes, the least page_id's is the response.

    Rows that also share the least page_id are all responses; without any page_id in such a group all are. The table of
    shared payloads holds one row per digest that occurs twice, counted before the shuffle.
    """
    pages = plain(pages, "page_id", "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), payload.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256))
    shared = (
        own.where(F.length("payload") >= LEAST_SHARED)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    # payloads that are never shared get keys of their own, so that all empty pages do not meet in one task; the pages of one
    # payload are dealt over SHARES keys, each of which finds the same narrow row
    key = F.when(F.length("payload") >= LEAST_SHARED, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    dealt = own.withColumn("_key", key).withColumn("_share", F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES)))
    shared = shared.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))
    return dealt.join(shared, (F.col("_key") == F.col("_digest")) & (F.col("_share") == F.col("_of")), "left").select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"), "payload_digest", "payload"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives written in the shared folder.

    Responses are read with their payloads, whose length and digest are taken anew; revisits by their headers alone. Null
    html is an empty payload; a null url or page_id is left out of the record and reads back as null. Repeated rows repeat.
    An empty table writes no archive and gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(as_records(pages), path)
    full = read_warc(spark, path).where("record_type = 'response'")
    bare = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return full.select(
        "page_id", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to"
    ).unionByName(bare.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= {LEAST_SHARED} group by payload_digest having count(*) > 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when f.first is not null and d.page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
  case when f.first is not null and d.page_id is distinct from f.first then f.first end as refers_to
from d left join f using (payload_digest)
"""
