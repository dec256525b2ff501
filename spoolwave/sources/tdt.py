"""Index-and-payload blocks: .tsq index, .tev payload, .sev channel files, offline sorts and notes."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolwave.sources import stretches
from spoolwave.sources.files import file_system, listing
from spoolwave.sources.records import RecordSource, shaped

# Event types and formats of the index.
STREAM, MASK, INVALID = 0x8101, 0xFF0F, 0xFFFF0000
KINDS = {0x101: "onset", 0x8801: "onset", 0x102: "offset", 0x201: "scalar", 0x8201: "snip"}
MARK_START, MARK_STOP = 1, 2
DTYPES = {0: "<f4", 1: "<i4", 2: "<i2", 3: "<i1", 4: "<f8", 5: "<i8"}
ITEM = {0: 4, 1: 4, 2: 2, 3: 1, 4: 8, 5: 8}
SEV_HEADER, V0_RATE = 40, 24414.0625
RECORD_HEADER_WORDS = 10


def blocks(path: str) -> list[str]:
    """Folders with an index file, sorted."""
    _, found = listing(path, ".tsq")
    return sorted({i.path.rsplit("/", 1)[0] for i in found})


def index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows with seq (ordinal among named records), kind and the time of the block's start."""
    spark.dataSource.register(RecordSource)
    raw = spark.read.format("records").option("format", "tsq").load(path)
    code = F.col("type")
    kind = F.lit(None).cast("string")
    for k, name in KINDS.items():
        kind = F.when(code == k, name).otherwise(kind)
    kind = F.when(code.bitwiseAND(F.lit(MASK)) == STREAM, "stream").otherwise(kind)
    # one block's index is one file; its records are numbered within it
    named = F.col("name") != ""
    w = Window.partitionBy("file").orderBy("k")
    rows = raw.withColumn("seq", F.when(named, F.sum(F.when(named, 1).otherwise(0)).over(w) - 1)).withColumn("kind", kind)
    return rows


#: The index record with its last-but-two field as the value of an event, which shares its place with a stream's file offset.
EVENT_FIELDS = [("size", "<i4"), ("type", "<i4"), ("name", "S4"), ("chan", "<u2"), ("sortcode", "<u2"), ("timestamp", "<f8"), ("value", "<f8"), ("format", "<i4"), ("freq", "<f4")]


def epoc_values(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, k, kind, name, chan, timestamp, value) of onsets, offsets and scalars of index files."""
    rows = shaped(spark, path, EVENT_FIELDS, 0, ".tsq", ["type", "name", "chan", "timestamp", "value"], **options)
    kind = F.lit(None).cast("string")
    for k, said in KINDS.items():
        kind = F.when(F.col("type") == k, said).otherwise(kind)
    # marks of the block itself have names of one unprintable byte
    return rows.withColumn("kind", kind).where((F.col("kind") != "snip") & (F.ascii("name") >= 32)).select("file", "k", "kind", "name", "chan", "timestamp", "value")


def streams(rows: DataFrame, tev: str) -> DataFrame:
    """Stretches of the packet streams: packets of a channel in order, all channels cut to the shortest."""
    fmt = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), F.col("format"))
    p = rows.where("kind = 'stream'").withColumn("item", fmt(ITEM)).withColumn("dtype", fmt(DTYPES)).where("item is not null")
    p = p.withColumn("n", F.floor((F.col("size") - RECORD_HEADER_WORDS) * 4 / F.col("item")))
    w = Window.partitionBy("name", "chan").orderBy("k")
    p = p.withColumn("first", F.sum("n").over(w) - F.col("n"))
    ends = p.groupBy("name", "chan").agg(F.sum("n").alias("_end")).groupBy("name").agg(F.min("_end").alias("_end"))
    p = p.join(ends, "name").withColumn("n", F.least("n", F.col("_end") - F.col("first"))).where("n > 0")
    one = lambda v: F.array(v)
    return p.select(
        F.col("name").alias("recording"), F.lit(tev).alias("path"), "first", F.col("n").cast("bigint").alias("samples"), F.col("offset").cast("bigint").alias("offset"), "dtype",
        F.col("item").cast("bigint").alias("step"), one(F.lit(0).cast("bigint")).alias("places"), one(F.col("chan").cast("int")).alias("channels"), one(F.lit(1.0)).alias("gains"), one(F.lit(0.0)).alias("shifts"),
    )


def snips(rows: DataFrame, tev: str, bytes_in_file: int, sorts: DataFrame | None = None) -> DataFrame:
    """(store, seq, t, channel, sort_code, path, offset, count, dtype): waveforms inside the file; offline codes win."""
    item = F.element_at(F.create_map(*[x for k, v in ITEM.items() for x in (F.lit(k), F.lit(v))]), F.col("format"))
    s = rows.where("kind = 'snip'").withColumn("count", F.floor((F.col("size") - RECORD_HEADER_WORDS) * 4 / item)).where((F.col("offset") + F.col("count") * item <= bytes_in_file) & (F.col("count") > 0))
    dtype = F.element_at(F.create_map(*[x for k, v in DTYPES.items() for x in (F.lit(k), F.lit(v))]), F.col("format"))
    s = s.select(F.col("name").alias("store"), "seq", F.col("timestamp").alias("t"), F.col("chan").alias("channel"), F.col("sortcode").alias("sort_code"), F.lit(tev).alias("path"), "offset", "count", dtype.alias("dtype"))
    if sorts is not None:
        s = s.join(sorts.select("seq", F.col("code").alias("_code")), "seq", "left").withColumn("sort_code", F.coalesce("_code", "sort_code")).drop("_code")
    return s


def sort_result(spark: SparkSession, path: str, **options) -> DataFrame:
    """(seq, code) of an offline sort: a 1024-byte channel map, then a code per record."""
    return shaped(spark, path, [("code", "u1")], 1024, **options).select(F.col("k").alias("seq"), F.col("code").cast("int").alias("code"))


def sev_header(raw: bytes) -> dict:
    """Version, store, channel, format and rate of a channel file's header."""
    if len(raw) < SEV_HEADER:
        raise ValueError("file is shorter than the 40-byte header")
    version = raw[11]
    if raw[8:11] != b"SEV" or version == 0:
        return {"version": 0, "store": None, "channel": None, "format": 0, "rate": V0_RATE}
    if version > 3:
        raise ValueError(f"SEV header version {version}")
    name = raw[12:16].split(b"\0")[0].decode("latin-1")
    u16 = lambda i: int.from_bytes(raw[i : i + 2], "little")
    return {"version": version, "store": name if version >= 3 and name else None, "channel": u16(16), "format": raw[24] & 7, "rate": 2.0 ** (u16(26) - 12) * 25e6 / max(raw[25], 1)}


def sev_name(stem: str) -> tuple[str | None, int | None, int]:
    """Store (last four-letter part between underscores), channel and hour of a file name."""
    parts = stem.split("_")
    store = next((p for p in reversed(parts[1:-1]) if len(p) == 4), None)
    channel, hour = re.search(r"(?i).*_ch(\d+)", stem), re.search(r"-(\d+)h$", stem)
    return store, int(channel[1]) if channel else None, int(hour[1]) if hour else 0


def sev_stretches(spark: SparkSession, path: str, tbk_rates: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(stretches, catalog) of a folder's channel files: a channel's hour files follow each other.

    The declared rate wins when it differs from the header's by more than 1 Hz; a store of several formats is an error.
    """
    fs, found = listing(path, ".sev")
    files = []
    for i in found:
        with fs.open_input_file(i.path) as f:
            head = sev_header(f.read(SEV_HEADER))
        store, channel, hour = sev_name(i.base_name.rsplit(".", 1)[0])
        files.append((head["store"] or store or "unnamed", head["channel"] if head["channel"] is not None else channel or 1, hour, i.path, i.size - SEV_HEADER, head["format"], head["rate"]))
    kinds: dict[str, set[int]] = {}
    for f in files:
        kinds.setdefault(f[0], set()).add(f[5])
    if mixed := [s for s, k in kinds.items() if len(k) > 1]:
        raise ValueError(f"stores of mixed formats: {mixed}")
    df = spark.createDataFrame(files, "store string, channel int, hour int, path string, bytes bigint, format int, rate double")
    item = F.element_at(F.create_map(*[x for k, v in ITEM.items() for x in (F.lit(k), F.lit(v))]), F.col("format"))
    dtype = F.element_at(F.create_map(*[x for k, v in DTYPES.items() for x in (F.lit(k), F.lit(v))]), F.col("format"))
    w = Window.partitionBy("store", "channel").orderBy("hour", "path").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("n", F.floor(F.col("bytes") / item)).withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))
    one = lambda v: F.array(v)
    s = df.select(F.col("store").alias("recording"), F.concat(F.lit("file://") if "://" not in path or path.startswith("file:") else F.lit(""), "path").alias("path"), "first", F.col("n").alias("samples"), F.lit(SEV_HEADER).cast("bigint").alias("offset"), dtype.alias("dtype"), item.cast("bigint").alias("step"), one(F.lit(0).cast("bigint")).alias("places"), one("channel").alias("channels"), one(F.lit(1.0)).alias("gains"), one(F.lit(0.0)).alias("shifts"))
    declared = F.lit(None).cast("double")
    for k, v in (tbk_rates or {}).items():
        declared = F.when(F.col("store") == k, v).otherwise(declared)
    catalog = df.groupBy("store").agg(F.first("rate").alias("_rate"), F.count_distinct("channel").alias("channels")).select("store", F.when(F.abs(declared - F.col("_rate")) > 1, declared).otherwise(F.col("_rate")).alias("rate"), "channels")
    return s, catalog


def rawpacked(words: DataFrame, word: str) -> DataFrame:
    """Both signals of a packed 32-bit word."""
    from spoolwave.functions.numeric import unpack_high, unpack_low

    return words.withColumn("high", unpack_high(F.col(word))).withColumn("low", unpack_low(F.col(word)))


def synapse_notes(text: str) -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """Fields, and notes as (clock, button, text), of a notes file; quoted text may span lines."""
    fields = dict(re.findall(r"(?m)^(Experiment|Subject|User|Start|Stop):[ \t]*(.*?)[ \t]*$", text))
    notes = []
    for clock, rest in re.findall(r"(?ms)^Note-\d+:[ \t]*(\d{1,2}:\d{2}:\d{2}[ap]m)[ \t]*(.*?)(?=^Note-\d+:|^Stop:|\Z)", text):
        button = re.search(r"\[([^\]]*)\]", rest)
        said = re.search(r'(?s)"(.*)"', rest)
        notes.append((clock, button[1] if button else "", said[1] if said else ""))
    return fields, notes


def store_listing(text: str) -> dict[str, dict[str, str]]:
    """Store descriptions of a listing: object, type and source by store."""
    out: dict[str, dict[str, str]] = {}
    section: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r"\s*(Object ID|Type|Store ID|Source|Rec Store)\s*:\s*(.*?)\s*$", line)
        if m and m[1] == "Object ID":
            head = re.match(r"(\S+)\s*-\s*(.+)", m[2])
            section = {"object": head[1], "type": head[2]} if head else {"object": m[2], "type": ""}
        elif m and m[1] in ("Store ID", "Rec Store"):
            out[m[2].split()[0]] = dict(section)
        elif m:
            section[m[1].lower()] = m[2]
    return out


def tin_summary(raw: bytes) -> dict[str, str]:
    """Section.Key map of the summary inside a .tin archive; NONE is dropped."""
    out, section = {}, ""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith("summary.txt")), None)
        for line in (z.read(name).decode("latin-1").splitlines() if name else ()):
            if m := re.match(r"\s*\[(.+)\]\s*$", line):
                section = m[1]
            elif (m := re.match(r"\s*([^=:]+?)\s*[=:]\s*(.*?)\s*$", line)) and m[2] and m[2] != "NONE":
                out[f"{section}.{m[1]}" if section else m[1]] = m[2]
    return out


def tnt_notes(text: str) -> list[str]:
    """Notes below the version line."""
    return [n for n in (line.strip() for line in text.splitlines()[1:]) if n]


def gap_log(text: str) -> tuple[int | None, list[tuple[int, int]]]:
    """Start sample and (sample, length) gaps of a recorder's log."""
    start = re.search(r"recording started at sample:\s*(\d+)", text)
    return int(start[1]) if start else None, [(int(a), int(b)) for a, b in re.findall(r"gap detected\.\s*last saved sample:\s*(\d+),\s*new saved sample:\s*(\d+)", text)]


def software_version(has_synapse: bool, has_openex: bool, notes_version: str | None) -> str:
    """Which program made a block, from its sidecars."""
    if has_synapse:
        return f"Synapse {notes_version}" if notes_version else "Synapse"
    return "OpenEx" if has_openex else "unknown"
