"""Binary and legacy recordings with JSON, NPY and XML sidecars."""

from __future__ import annotations

import io
import json
import re
from collections import Counter
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolwave.sources import stretches
from spoolwave.sources.files import file_system, listing
from spoolwave.sources.records import shaped

LEGACY_HEADER, LEGACY_BLOCK = 1024, 1024


def walk(path: str, name: str, depth: int = 4) -> list[str]:
    """Folders that hold a file of that name, at most `depth` levels down; below a match nothing is searched."""
    fs, base = file_system(path)
    out, todo = [], [(base, 0)]
    import pyarrow.fs as pafs

    while todo:
        at, level = todo.pop(0)
        found = fs.get_file_info(pafs.FileSelector(at))
        if any(i.base_name == name and i.is_file for i in found):
            out.append(at)
        elif level < depth:
            todo += sorted((i.path, level + 1) for i in found if i.type == pafs.FileType.Directory)
    return out


def volts(units: str, factor: float) -> float:
    """Volts per bit: the factor in its unit, microvolts unless stated."""
    return factor * {"V": 1.0, "mV": 1e-3}.get(units, 1e-6)


def structure(text: str) -> list[dict]:
    """(folder, rate, channels with gain) of each continuous stream of a structure file, typed with defaults."""
    out = []
    for s in json.loads(text).get("continuous", []):
        chans = []
        for c in s.get("channels", []):
            name, said = c.get("channel_name", ""), (c.get("description") or "").lower()
            role = "sync" if name.endswith("_SYNC") or "sync line" in said else "analog" if name.startswith(("ADC", "AUX")) else "electrode"
            chans.append({"name": name, "role": role, "gain": 1.0 if role == "sync" else volts(c.get("units", ""), float(c.get("bit_volts", 1.0)))})
        out.append({"folder": s.get("folder_name", "").rstrip("/"), "name": s.get("stream_name") or s.get("folder_name", "").rstrip("/"), "rate": float(s.get("sample_rate", 0)), "channels": chans})
    return out


def binary_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of the .dat files of a recording folder; absent ones are left out."""
    fs, base = file_system(f"{folder}/structure.oebin")
    with fs.open_input_file(base) as f:
        found = structure(f.read().decode())
    rows = []
    for s in found:
        path = f"{folder}/continuous/{s['folder']}/continuous.dat"
        info = fs.get_file_info(file_system(path)[1])
        n = len(s["channels"])
        if info.is_file and n:
            rows.append(stretches.stretch(s["name"], path, info.size // (2 * n), 0, "<i2", 2 * n, [2 * c for c in range(n)], None, [c["gain"] for c in s["channels"]]))
    return stretches.table(spark, rows)


def npy(raw: bytes) -> np.ndarray:
    """A little-endian, C-ordered array of numbers or bytes."""
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if a.dtype.byteorder == ">" or (a.ndim > 1 and not a.flags.c_contiguous) or a.dtype.kind not in "iufS":
        raise ValueError(f"array of type {a.dtype.str} is not read")
    return a


def settings(text: str) -> dict:
    """Date, version and probe sites of a settings file."""
    root = ElementTree.fromstring(text)
    one = lambda tag: next((e.text for e in root.iter(tag) if e.text), None)
    sites = {}
    for x, y in zip(root.iter("ELECTRODE_XPOS"), root.iter("ELECTRODE_YPOS")):
        sites |= {k: (float(v), float(y.attrib[k])) for k, v in x.attrib.items() if k in y.attrib}
    return {"date": one("DATE"), "version": one("VERSION"), "sites": sites}


def settings_name(start: int) -> str:
    """Settings file of the n-th start."""
    return f"settings_{start}.xml" if start > 1 else "settings.xml"


def processor_names(text: str) -> dict[str, str]:
    """Name by number of the processors: the last part of the path, spaces as '_' (T35)."""
    return {p.get("nodeId") or p.get("NodeId"): (p.get("name") or "").split("/")[-1].strip().replace(" ", "_") for p in ElementTree.fromstring(text).iter("PROCESSOR")}


def legacy_name(file: str) -> tuple[str, str | None, str, int] | None:
    """Processor, source, item and start of a legacy file's name."""
    stem, _, ext = file.rpartition(".")
    parts = stem.split("_")
    start = 1
    if len(parts) > 1 and re.fullmatch(r"[1-9]\d*|0", parts[-1]):
        start = int(parts.pop())
    if ext != "continuous":
        return "", None, "_".join(parts), start
    if len(parts) < 2:
        return None
    return parts[0], "_".join(parts[1:-1]) or None, parts[-1], start


def legacy_runs(records: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(file, first, n, samples) of records (file, k, timestamp, samples): the records' own runs, and a run without samples for each
    gap, cut to the range that all files share and to start..end (S44, J21, W16).

    A gap is a row of its first sample number and its length, however long. The record after another one is found by a join on
    record numbers, so a file's records are never one task.
    """
    own = records.select("file", F.col("k").cast("bigint").alias("k"), F.col("timestamp").alias("first"), "samples")
    span = own.groupBy("file").agg(F.min("first").alias("a"), F.max("first").alias("b")).agg(F.max("a").alias("_from"), F.min(F.col("b") + LEGACY_BLOCK).alias("_to"))
    after = own.select("file", (F.col("k") - 1).alias("k"), F.col("first").alias("_next"))
    ends = own.select("file", "k", "first").join(after, ["file", "k"], "left")
    gaps = ends.where(F.col("_next") > F.col("first") + LEGACY_BLOCK).select("file", (F.col("first") + LEGACY_BLOCK).alias("first"), F.col("_next").alias("_end"), F.lit(None).cast("array<smallint>").alias("samples"))
    runs = own.select("file", "first", (F.col("first") + F.size("samples")).alias("_end"), "samples").unionByName(gaps).join(F.broadcast(span))
    low, high = F.greatest("first", "_from", F.lit(start).cast("bigint")), F.least("_end", "_to", F.lit(end).cast("bigint"))  # nulls are skipped
    cut = runs.withColumn("_low", low).withColumn("_n", (high - low)).where("_n > 0")
    inside = F.when(F.col("samples").isNotNull(), F.slice("samples", (F.col("_low") - F.col("first") + 1).cast("int"), F.greatest(F.col("_n"), F.lit(0)).cast("int")))
    return cut.select("file", F.col("_low").alias("first"), F.col("_n").alias("n"), inside.alias("samples"))


def legacy_chunks(records: DataFrame, start: int | None = None, end: int | None = None, piece: int = 65536) -> DataFrame:
    """(file, first, values) over the range: records as they are, gaps as zeros in pieces of at most `piece` samples."""
    runs = legacy_runs(records, start, end)
    part = F.explode(F.when(F.col("samples").isNotNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / piece))))
    each = runs.withColumn("_k", part)
    zeros = F.array_repeat(F.lit(0).cast("smallint"), F.least(F.lit(piece), F.col("n") - F.col("_k") * piece).cast("int"))
    return each.select("file", (F.col("first") + F.col("_k") * piece).alias("first"), F.coalesce("samples", zeros).alias("values"))


def legacy_samples(records: DataFrame, gains: dict[str, float] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(file, sample, value): records cut to the range that all files share, gaps read as 0."""
    rows = legacy_chunks(records, start, end).select("file", "first", F.posexplode("values").alias("_i", "value"))
    gain = F.lit(1.0)
    for k, g in (gains or {}).items():
        gain = F.when(F.col("file") == k, g).otherwise(gain)
    return rows.select("file", (F.col("first") + F.col("_i")).alias("sample"), (F.col("value") * gain).cast("float").alias("value"))


def locate(points: DataFrame, records: DataFrame, block: int = LEGACY_BLOCK) -> DataFrame:
    """points (file, sample, ...) with `k` and `offset`: the record that holds the sample and the place in it, null in a gap.

    Every record lies in at most two stretches of `block` samples, so records and points meet in an equal join on file and stretch:
    a file is as many keys as it has stretches, and a point meets one or two records. Of records that overlap the last one holds.
    Points that are asked twice are answered twice.
    """
    first = F.col("timestamp")
    index = records.select("file", F.col("k").alias("_k"), first.alias("_first"), F.explode(F.array_distinct(F.array(F.floor(first / block), F.floor((first + block - 1) / block)))).alias("_stretch"))
    asked = points.withColumn("_stretch", F.floor(F.col("sample") / block)).withColumn("_point", F.monotonically_increasing_id())
    index = index.withColumnRenamed("file", "_file")
    on = (F.col("file") == F.col("_file")) & (asked["_stretch"] == index["_stretch"]) & (F.col("_first") <= F.col("sample")) & (F.col("sample") < F.col("_first") + block)
    met = asked.join(index, on, "left").drop(index["_stretch"])
    best = met.groupBy(*points.columns, "_stretch", "_point").agg(F.max(F.struct("_first", "_k")).alias("_r"))
    return best.select(*points.columns, F.col("_r._k").alias("k"), (F.col("sample") - F.col("_r._first")).alias("offset"))


def legacy_spikes(spark: SparkSession, path: str, channels: int, samples: int, **options) -> DataFrame:
    """(file, k, channel, waveform) in volts of spike files: record = 42 + n m 2 + n 4 + n 2 + 2 bytes."""
    n, m = channels, samples
    fields = [("head", "V42"), ("wave", "<u2", (n, m)), ("gain", "<f4", (n,)), ("threshold", "<u2", (n,)), ("recording", "<u2")]
    rows = shaped(spark, path, fields, LEGACY_HEADER, ".spikes", ["wave", "gain"], **options)
    long = rows.select("file", "k", "gain", F.posexplode("wave").alias("channel", "raw")).withColumn("_g", F.get("gain", F.col("channel")).cast("double"))
    scale = F.when(F.col("_g") != 0, 1e-3 / F.col("_g")).otherwise(0.0)
    return long.withColumn("_s", scale).select("file", "k", "channel", F.transform("raw", lambda v: ((v - 32768) * F.col("_s")).cast("float")).alias("waveform"))


#: What is read of a structure file.
OEBIN = "struct<continuous: array<struct<folder_name: string, stream_name: string, sample_rate: double, channels: array<struct<channel_name: string, bit_volts: double, units: string, description: string>>>>>"


def structures(sidecars: DataFrame, text: str = "text") -> DataFrame:
    """sidecars with (folder, stream, rate, channels: name, role, gain) of each continuous stream in a structure file's text (S40,
    T26, P10): files of any number of sessions are parsed where they lie."""
    s = sidecars.withColumn("_s", F.explode(F.from_json(F.col(text), OEBIN)["continuous"])).drop(text)
    folder = F.regexp_replace(F.coalesce("_s.folder_name", F.lit("")), "/+$", "")

    def channel(c):
        name, said = F.coalesce(c["channel_name"], F.lit("")), F.lower(F.coalesce(c["description"], F.lit("")))
        role = F.when(name.endswith("_SYNC") | said.contains("sync line"), "sync").when(name.startswith("ADC") | name.startswith("AUX"), "analog").otherwise("electrode")
        unit = F.when(c["units"] == "V", 1.0).when(c["units"] == "mV", 1e-3).otherwise(1e-6)
        return F.struct(name.alias("name"), role.alias("role"), F.when(role == "sync", 1.0).otherwise(F.coalesce(c["bit_volts"], F.lit(1.0)) * unit).alias("gain"))

    keep = [c for c in sidecars.columns if c != text]
    return s.select(*keep, folder.alias("folder"), F.coalesce(F.when(F.col("_s.stream_name") != "", F.col("_s.stream_name")), folder).alias("stream"), F.coalesce("_s.sample_rate", F.lit(0.0)).alias("rate"), F.transform(F.coalesce("_s.channels", F.array().cast("array<struct<channel_name: string, bit_volts: double, units: string, description: string>>")), channel).alias("channels"))


def _settings_said(texts: pa.Array) -> pa.Array:
    """What the elements of settings texts say, each text parsed once: first date and version (null if empty), the processors' names
    and numbers in the order of the file. A text that is no XML stops the job; null and empty texts say nothing."""

    def first(root: ElementTree.Element, tag: str) -> str | None:
        found = next(root.iter(tag), None)
        return "".join(found.itertext()) or None if found is not None else None

    def said(t: str) -> dict:
        tree, parser = ElementTree.TreeBuilder(), expat.ParserCreate("utf-8")  # names as they are written, whatever their namespace
        parser.buffer_text, parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = True, tree.start, tree.end, tree.data
        parser.Parse(t, True)
        root = tree.close()
        them = [p.attrib for p in root.iter("PROCESSOR")]
        return {"date": first(root, "DATE"), "version": first(root, "VERSION"), "names": [a["name"] for a in them if "name" in a], "numbers": [a[k] for a in them for k in ("NodeId", "nodeId") if k in a]}

    kind = pa.struct([("date", pa.string()), ("version", pa.string()), ("names", pa.list_(pa.string())), ("numbers", pa.list_(pa.string()))])
    return pa.array([said(t) if t else None for t in texts.to_pylist()], kind)


def settings_rows(sidecars: DataFrame, text: str = "text") -> DataFrame:
    """sidecars with (date, version, processors, sites) of a settings file's text (S43, T20, T35): processors by number, the sites' x and
    y by channel, for files of any number of sessions."""
    x = F.col(text)
    said = F.arrow_udf(_settings_said, "struct<date: string, version: string, names: array<string>, numbers: array<string>>")(x)
    names = F.transform("_said.names", lambda n: F.regexp_replace(F.trim(F.element_at(F.split(n, "/"), -1)), " ", "_"))

    def places(axis: str):
        element = F.regexp_extract(x, f"<ELECTRODE_{axis}POS\\b([^>]*)>", 1)
        keys, values = (F.regexp_extract_all(element, F.lit(r"""([\w:.-]+)\s*=\s*["']([^"']*)["']"""), F.lit(i)) for i in (1, 2))
        return F.map_from_arrays(keys, F.transform(values, lambda v: v.cast("double")))

    both = F.map_filter(F.map_zip_with(places("X"), places("Y"), lambda _, a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("x"), b.alias("y")))), lambda _, v: v.isNotNull())
    keep = [c for c in sidecars.columns if c != text]
    return sidecars.select(*keep, text, said.alias("_said")).select(*keep, "_said.date", "_said.version", F.map_from_arrays("_said.numbers", names).alias("processors"), both.alias("sites"))


def session_stretches(sessions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stretches of many recording folders at once (S40, S41): sessions (path, text of the structure file), sizes (path, bytes) of the
    folders' data files. Nothing but the tables is looked at; a file that is absent has no size and is left out."""
    streams = structures(sessions).withColumn("_file", F.concat("path", F.lit("/continuous/"), "folder", F.lit("/continuous.dat")))
    known = sizes.select(F.col("path").alias("_file"), F.col("bytes"))
    n = F.size("channels")
    each = lambda what: F.transform(F.sequence(F.lit(0), n - 1), what)
    return streams.where(n > 0).join(known, "_file").select(
        F.concat_ws("/", F.element_at(F.split("path", "/"), -1), F.col("stream")).alias("recording"), F.col("_file").alias("path"), F.lit(0).cast("bigint").alias("first"), F.floor(F.col("bytes") / (2 * n)).alias("samples"),
        F.lit(0).cast("bigint").alias("offset"), F.lit("<i2").alias("dtype"), (2 * n).cast("bigint").alias("step"), each(lambda i: (2 * i).cast("bigint")).alias("places"), each(lambda i: i).alias("channels"),
        F.transform("channels", lambda c: c["gain"]).alias("gains"), each(lambda i: F.lit(0.0)).alias("shifts"),
    )


def software_time(text: str) -> int | None:
    """Milliseconds since the epoch in a sync message."""
    m = re.search(r"Software Time \(milliseconds since midnight Jan 1st 1970 UTC\):\s*(\d+)", text)
    return int(m[1]) if m else None


def start_counts(path: str) -> Counter:
    """Files per start of a legacy folder."""
    return Counter(p[3] for i in listing(path, ".continuous")[1] if (p := legacy_name(i.base_name)))
