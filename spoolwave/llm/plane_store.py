"""Token ids in binary files: blocks of ids transposed into bit or byte planes, each plane compressed, a chunk index at the end.

A file holds documents in ascending order of their ids and is laid out as

    magic, chunks of ids, chunks of documents, index, length of the index (8 bytes), magic

A chunk of ids is CHUNK ids (fewer at the end) as 32-bit numbers, a chunk of documents up to DOCUMENTS pairs of (doc_id, count) as
64-bit numbers. Both are transposed into planes, and every plane is compressed alone; a plane of zeros takes no room. The index,
compressed JSON, names the place of every chunk and the lengths of its planes, so a reader finds any stretch of ids with two reads.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from spoolwave.llm.common import SPLIT_BYTES, map_batches, plain, scratch_path, text_col

MAGIC = b"SPLANE1\n"
CHUNK = 1 << 18
DOCUMENTS = 1 << 14
#: Chunks of documents that one read task gets, and bytes of ids in a batch handed to Spark.
STRETCH = 4
BATCH_BYTES = 8 << 20
END_ID = 2
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
#: Fixed value: characters that a byte-level pre-tokenizer takes for white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that a worker remembers; a full table becomes the old one, whose pieces return when they are met again.
CACHED_PIECES = 700_000
#: Characters of texts that are encoded together.
GROUP_CHARS = 1_000_000
#: Marks that end a word; behind a letter a run of them is a pre-token of its own (no apostrophe, and none that added tokens have).
MARKS = '!"#$%&()*+,-./:;=?@[]^_`{}~'
#: Letters below this are letters in every version of the character tables; others take the library's whole way.
LETTERS_END = "\u0530"


def _byte_signs() -> dict[int, str]:
    """The signs by which a byte-level vocabulary writes bytes: visible Latin-1 characters are themselves, the rest follow from U+0100."""
    hidden = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs() | {10: "\n"}  # the line end parts words


# planes


def to_planes(values: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (one per byte of the number, lowest first) or bit planes of unsigned numbers."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [p.tobytes() for p in raw.T]


def from_planes(planes: list[bytes], n: int, kind: np.dtype, bits: bool) -> np.ndarray:
    if bits:
        rows = np.unpackbits(np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1), axis=1, count=n, bitorder="little")
        return np.packbits(rows.T, axis=1, bitorder="little").reshape(-1).view(kind)
    return np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), n).T).reshape(-1).view(kind)


class Codec:
    """Packs arrays of numbers into planes and back; used for ids (32 bits) and documents (64 bits) alike."""

    def __init__(self, bits: bool = False, level: int = 1) -> None:
        self.bits, self.pack_, self.unpack_ = bits, zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()

    def pack(self, values: np.ndarray) -> tuple[bytes, list[int]]:
        """Compressed planes end to end, and their lengths; a plane of zeros has length 0."""
        done = [self.pack_.compress(p) if p.count(0) < len(p) else b"" for p in to_planes(values, self.bits)]
        return b"".join(done), [len(p) for p in done]

    def unpack(self, data: bytes, lengths: list[int], n: int, kind: np.dtype) -> np.ndarray:
        size, at, planes = -(-n // 8) if self.bits else n, 0, []
        for length in lengths:
            planes.append(self.unpack_.decompress(data[at : at + length], max_output_size=size) if length else bytes(size))
            at += length
        return from_planes(planes, n, kind, self.bits)


# files


class FileWriter:
    """Writes one file; holds no more than a chunk of ids and a chunk of documents, whatever the length of a document."""

    def __init__(self, out, codec: Codec, chunk: int = CHUNK) -> None:
        self.out, self.codec, self.chunk = out, codec, chunk
        self.at = self.ids = self.docs = 0
        self.buffer, self.held = [], 0
        self.chunks: list[list] = []
        self.rows: list[tuple[int, int, int]] = []
        self.doc_first, self.doc_chunks = 0, []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id or 0, doc_id is not None, len(ids)))
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        while len(ids):
            part = ids[: self.chunk - self.held]
            self.buffer.append(part)
            self.held, ids = self.held + len(part), ids[len(part) :]
            if self.held == self.chunk:
                self._flush_ids()
        if len(self.rows) == DOCUMENTS:
            self._flush_docs()

    def _flush_ids(self) -> None:
        if self.held:
            values = np.concatenate(self.buffer).astype("<u4", copy=False)
            data, lengths = self.codec.pack(values)
            self.chunks.append([self.at, len(values), lengths])
            self._put(data)
            self.buffer, self.held = [], 0

    def _flush_docs(self) -> None:
        """Documents wait for their chunk in memory until the ids before them are out; ids go on, so chunks of both kinds mix."""
        if self.rows:
            doc_ids, given, counts = zip(*self.rows)
            values = np.concatenate([np.array(doc_ids, "<i8").view("<u8"), np.array(given, "<u8"), np.array(counts, "<u8")])
            data, lengths = self.codec.pack(values)
            self.doc_chunks.append([self.at, len(self.rows), lengths, self.doc_first])
            self._put(data)
            self.doc_first, self.rows = self.ids, []

    def close(self) -> None:
        self._flush_docs()
        self._flush_ids()
        index = zstandard.compress(json.dumps({"planes": "bit" if self.codec.bits else "byte", "chunk": self.chunk, "ids": self.ids, "docs": self.docs, "chunks": self.chunks, "documents": self.doc_chunks}).encode())
        self._put(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()


class FileReader:
    """Reads stretches of one file by its index; keeps the last chunk, so neighbouring documents decode a chunk once."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.f, size = fs.open_input_file(path), fs.get_file_info(path).size
        tail = len(MAGIC) + 8
        end = self.f.read_at(tail, size - tail)
        if end[8:] != MAGIC:
            raise ValueError(f"{path} is not a complete file of token ids")
        length = int.from_bytes(end[:8], "little")
        self.index = json.loads(zstandard.decompress(self.f.read_at(length, size - tail - length)))
        self.codec = Codec(self.index["planes"] == "bit")
        self.last = (-1, np.empty(0, "<u4"))

    def _load(self, entry: list, n: int, kind: str) -> np.ndarray:
        return self.codec.unpack(self.f.read_at(sum(entry[2]), entry[0]), entry[2], n, np.dtype(kind))

    def documents(self, k: int) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, first id within the file, count) of the k-th chunk of documents."""
        entry = self.index["documents"][k]
        doc_ids, given, counts = self._load(entry, 3 * entry[1], "<u8").reshape(3, -1)
        firsts = entry[3] + np.cumsum(counts.astype(np.int64)) - counts.astype(np.int64)
        return zip((i if g else None for i, g in zip(doc_ids.view("<i8").tolist(), given.tolist())), firsts.tolist(), counts.astype(np.int64).tolist())

    def chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.last = (k, self._load(self.index["chunks"][k], self.index["chunks"][k][1], "<u4"))
        return self.last[1]

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the first-th on; only the chunks they lie in are read."""
        size, parts = self.index["chunk"], []
        while n:
            k, at = divmod(first, size)
            parts.append(self.chunk(k)[at : at + n])
            first, n = first + len(parts[-1]), n - len(parts[-1])
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


# data source


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    docs: int
    ids: int
    stretches: int


class PlaneWriter(DataSourceArrowWriter):
    """A file per task under a fresh name. The manifest, written at commit, names the files of successful attempts in order of
    their partitions with the ids before each; what other attempts left is no part of the store."""

    def __init__(self, path: str, bits: bool, chunk: int, vocabulary: str | None = None, end_id: int | None = None) -> None:
        self.path, self.bits, self.chunk, self.vocabulary, self.end_id = path, bits, chunk, vocabulary, end_id

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of a batch: given, or encoded here where the store is given texts."""
        doc_ids = batch.column("doc_id").to_pylist()
        if self.vocabulary is None:
            yield from zip(doc_ids, (x.as_buffer() or b"" for x in batch.column("ids")))
            return
        enc, end, at = encoder(self.vocabulary), end_bytes(self.end_id), 0
        for own in texts_in_groups(batch.column("text")):
            yield from zip(doc_ids[at : at + len(own)], enc.encode_all(own, end))
            at += len(own)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        part, name, writer = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.planes", None
        for batch in iterator:
            for doc_id, ids in self.rows(batch):
                writer = writer or FileWriter(fs.open_output_stream(f"{base}/{name}", compression=None), Codec(self.bits), self.chunk)
                writer.add(doc_id, np.frombuffer(ids, "<u4"))
        if writer is None:
            return Written(part, "", 0, 0, 0)
        writer.close()
        return Written(part, name, writer.docs, writer.ids, len(writer.doc_chunks))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        files, first = [], 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition):
            files.append([m.name, first, m.docs, m.ids, m.stretches])
            first += m.ids
        with fs.open_output_stream(f"{base}/manifest.json", compression=None) as out:
            out.write(json.dumps({"ids": first, "files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{base}/{m.name}")


@dataclass
class Stretch(InputPartition):
    name: str
    first: int
    begin: int
    end: int


class PlaneReader(DataSourceReader):
    """A task reads some chunks of documents of one file, and the chunks of ids that they lie in."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Stretch]:
        return [Stretch(name, first, k, min(k + STRETCH, n)) for name, first, _, _, n in manifest(self.path)["files"] for k in range(0, n, STRETCH)] or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, base = pafs.FileSystem.from_uri(self.path)
        reader = FileReader(fs, f"{base}/{partition.name}")
        rows, held = [], 0
        for k in range(partition.begin, partition.end):
            for doc_id, first, n in reader.documents(k):
                rows.append((doc_id, partition.first + first, n, reader.ids(first, n).tobytes()))
                held += 4 * n
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def manifest(path: str) -> dict:
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{base}/manifest.json", compression=None) as f:
        return json.loads(f.read())


class PlaneSource(DataSource):
    """format("planes"): option path; when written also planes (byte or bit) and chunk (ids). With the option vocabulary (and endId)
    the rows to write are (doc_id, text) and encoded by the task that writes them, else (doc_id, ids)."""

    @classmethod
    def name(cls) -> str:
        return "planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PlaneReader:
        return PlaneReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PlaneWriter:
        end = self.options.get("endId")
        return PlaneWriter(self.options["path"], self.options.get("planes", "byte") == "bit", int(self.options.get("chunk", CHUNK)), self.options.get("vocabulary"), int(end) if end else None)


def write_planes(rows: DataFrame, path: str, planes: str = "byte", chunk: int = CHUNK, vocabulary: str | None = None, end_id: int | None = None) -> None:
    """Write (doc_id, ids binary), or with a vocabulary (doc_id, text), dealt and sorted as they are to be stored: a file per
    partition in partition order."""
    rows.sparkSession.dataSource.register(PlaneSource)
    options = {"planes": planes, "chunk": str(chunk)}
    if vocabulary is not None:
        options |= {"vocabulary": vocabulary} | ({} if end_id is None else {"endId": str(end_id)})
    rows.select("doc_id", "ids" if vocabulary is None else "text").write.format("planes").options(**options).mode("append").save(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a store; ids are 32-bit little-endian numbers, start counts all ids before the document."""
    spark.dataSource.register(PlaneSource)
    return spark.read.format("planes").load(path)


def read_window(path: str, first: int, n: int) -> np.ndarray:
    """Up to n ids from the first-th of the whole store on, across documents and files: what a trainer's loader asks for."""
    fs, base = pafs.FileSystem.from_uri(path)
    parts = []
    for name, start, _, ids, _ in manifest(path)["files"]:
        low, high = max(first, start), min(first + n, start + ids)
        if low < high:
            parts.append(FileReader(fs, f"{base}/{name}").ids(low - start, high - low))
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


# encoding


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once.

    A piece is a run of white space with the run of other characters that follows. No token, added ones included, goes over the
    end of such a piece, as the pre-tokenizer starts a word at most one white space early; so a text's ids are its pieces' ids
    end to end. For the same reason full stops, commas and the like behind a letter are words of their own. A new piece of
    letters alone is one word, which goes to the library's model as it is; any other one takes the library's whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.tokenize = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Put these pieces into the young table."""
        young, old, ends, new = self.young, self.old, [], []
        for p in pieces:
            if p in old:
                young[p] = old[p]
            elif p[-1] in MARKS and (word := p.rstrip(MARKS)) and word[-1].isalpha():
                ends.append((p, word, p[len(word) :]))
            else:
                new.append(p)
        for w in {w for e in ends for w in e[1:] if w not in young}.difference(new):
            if w in old:
                young[w] = old[w]
            else:
                new.append(w)
        rest, words = [], []
        for p in new:
            word = p[1:] if p[0] == " " else p
            (words if word.isalpha() and (word.isascii() or max(word) < LETTERS_END) else rest).append(p)
        if words:
            signs = "\n".join(words).encode().decode("latin-1").translate(BYTE_SIGNS).split("\n")
            found = list(map(self.tokenize, signs))
            raw = array("I", [t.id for tokens in found for t in tokens]).tobytes()
            at = 0
            for p, n in zip(words, map(len, found)):
                young[p] = raw[at : at + 4 * n]
                at += 4 * n
        for at in range(0, len(rest), 4096):
            own = rest[at : at + 4096]
            for p, found in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False)):
                young[p] = array("I", found.ids).tobytes()
        for p, word, mark in ends:
            young[p] = young[word] + young[mark]

    def encode_all(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text, with the end id behind."""
        split = list(map(self.pieces, texts))
        pieces = set().union(*split)
        if len(self.young) > CACHED_PIECES:  # what these texts need comes back from the old table or is encoded
            self.old, self.young = self.young, {}
        self.learn(pieces.difference(self.young))
        return [b"".join(itemgetter(*pieces, pieces[0])(self.young)[:-1]) + end if pieces else end for pieces in split]

    def encode(self, text: str, end: bytes = b"") -> bytes:
        return self.encode_all([text], end)[0]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(vocabulary: str) -> PieceEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, PieceEncoder(vocabulary))


def texts_in_groups(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, about GROUP_CHARS at a time."""
    own, chars = [], 0
    for t in texts:
        own.append(t.as_py())
        chars += len(own[-1])
        if chars > GROUP_CHARS:
            yield own
            own, chars = [], 0
    if own:
        yield own


def end_bytes(end_id: int | None) -> bytes:
    return b"" if end_id is None else np.array([end_id], "<u4").tobytes()


def token_bytes(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids binary) of docs(doc_id, text), in their order and partitions; for ids that go elsewhere than into a store."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, end = encoder(vocabulary), end_bytes(end_id)
        ids = [x for own in texts_in_groups(batch.column(1)) for x in enc.encode_all(own, end)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, ids binary")


def store(docs: DataFrame, vocabulary: str, path: str, planes: str = "byte", chunk: int = CHUNK) -> None:
    """Encode whole texts, end each with END_ID, and write them in ascending order of doc_id (rows without one last).

    Texts are dealt by sampled ranges of doc_id, and of the text's hash among rows of one id, so that repeated ids are no single
    task; each task encodes its range and writes its file. Null text is empty: the end id alone.
    """
    docs = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-size // SPLIT_BYTES) if size < 1 << 60 else 0  # a table without statistics claims the largest number
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), by_size)
    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie").asc(), F.col("_row").asc()]
    told = docs.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    write_planes(told.repartitionByRange(parts, *order).sortWithinPartitions(*order), path, planes, chunk, vocabulary, END_ID)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), one row per input row, from files written in the shared folder and read back.

    Repeated rows repeat, each at its own start. A very long text goes over many chunks. An empty table writes an empty manifest and
    gives an empty result.
    """
    path = scratch_path(docs.sparkSession, "planes")
    store(docs, vocabulary, path)
    return read_planes(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
