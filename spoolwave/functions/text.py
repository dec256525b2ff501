"""Text, date, array and map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(s: Column) -> Column:
    """Name without slashes: trailing ones go, inner ones become '_', nothing left is 'unnamed' (T01)."""
    bare = F.regexp_replace(F.regexp_replace(s, r"[/\\]+$", ""), r"[/\\]", "_")
    return F.when(bare == "", "unnamed").otherwise(bare)


def store_file(name: Column) -> tuple[Column, Column, Column]:
    """Store, channel and hour of a file name like block_Store_Ch12-3h.sev."""
    pattern = r"(?i)^.*_([^_]+)_ch(\d+)(?:-(\d+)h)?\.sev$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return part(1), part(2).cast("int"), F.when(part(1).isNotNull(), F.coalesce(part(3).cast("int"), F.lit(0)))


def subset(s: Column) -> Column:
    """Channels of a list like '0:3,7': inclusive ranges, single numbers; null for 'all' (T05)."""
    ends = F.transform(F.split(s, ","), lambda p: F.struct(F.element_at(F.split(p, ":"), 1).cast("int").alias("a"), F.element_at(F.split(p, ":"), -1).cast("int").alias("b")))
    return F.when(F.trim(s) != "all", F.flatten(F.transform(ends, lambda e: F.when(e["b"] >= e["a"], F.sequence(e["a"], e["b"])).otherwise(F.array().cast("array<int>")))))


def entries(s: Column) -> Column:
    """Contents of the parentheses of '(head)(a)(b)', the head left out."""
    found = F.regexp_extract_all(s, F.lit(r"\(([^)]*)\)"), F.lit(1))
    return F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))


def counts(s: Column) -> Column:
    """Numbers of a comma list, null where a part is none."""
    return F.transform(F.split(s, ","), lambda p: F.trim(p).try_cast("int"))


def model(s: Column) -> Column:
    """Device name without its counter: RZ2(1) is RZ2."""
    bare = F.regexp_extract(s, r"^(.+?)\((\d+)\)$", 1)
    return F.when(bare == "", s).otherwise(bare)


def bank(n: Column) -> Column:
    """Bank letter of 1..26."""
    return F.when(n.between(1, 26), F.chr(n + 64))


def note_label(button: Column, text: Column) -> Column:
    """'button: text', either alone, or nothing."""
    return F.concat_ws(": ", F.nullif(button, F.lit("")), F.nullif(text, F.lit("")))


def up_to_nul(s: Column) -> Column:
    """Text before the first NUL."""
    return F.substring_index(s, "\u0000", 1)


def iso_from_micros(us: Column) -> Column:
    """ISO time of microseconds since the epoch, a fraction only if there is one, no zone."""
    ts = F.timestamp_micros(us)
    return F.when(F.pmod(us, F.lit(1000000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


_ZONE = r"(Z|[+-]\d{2}:\d{2})$"


def has_zone(s: Column) -> Column:
    """Whether a time ends with Z or an offset."""
    return s.rlike(_ZONE)


def micros_from_iso(s: Column) -> Column:
    """Microseconds since the epoch of an ISO time; a zone is not applied."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(s, _ZONE, "")))


def start_time(stated: Column, zone: Column, recorded: Column) -> Column:
    """Start with zone: the stated one, or stated or recorded with the zone given; null if none has a zone."""
    zoned = lambda t: F.when(has_zone(t), t).otherwise(F.concat(t, zone))
    return F.coalesce(F.when(stated.isNotNull(), zoned(stated)), zoned(recorded))


def clock_seconds(s: Column) -> Column:
    """Seconds of a day of '1:02:03pm' or '13:02:03' (T18)."""
    pattern = r"(?i)^(\d{1,2}):(\d{2}):(\d{2})\s*([ap]m)?$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    half = F.lower(part(4))
    hour = part(1).try_cast("int")
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    return hour * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int")


def stamp_in_name(s: Column) -> Column:
    """Time of a name that ends with _YYMMDD_HHMMSS."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(s, r"_(\d{6}_\d{6})$", 1), F.lit("")), F.lit("yyMMdd_HHmmss"))


def age(s: Column) -> tuple[Column, Column]:
    """Number and unit of a duration like P90D."""
    part = lambda i: F.nullif(F.regexp_extract(s, r"^P(\d+)([DWMY])$", i), F.lit(""))
    return part(1).cast("int"), part(2)


def event_values(values: Column, event: Column, channels: int) -> Column:
    """Values of one event of a row-major array."""
    return F.slice(values, (event * channels + 1).cast("int"), channels)


def hex16(n: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(n), 16, "0"))


def last_part(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def number_text(v: Column) -> Column:
    """A number as text, integers without decimals."""
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def per_channel(words: Column, n: int) -> Column:
    """One value stands for all channels."""
    return F.when(F.size(words) == 1, F.array_repeat(F.element_at(words, 1), n)).otherwise(words)


def output_name(path: Column, suffix: str) -> Column:
    """Path with its archive suffix replaced."""
    return F.concat(F.regexp_replace(path, r"(?i)\.nwb(\.zarr)?$", ""), F.lit(suffix))


def output_format(path: Column) -> Column:
    """Single-file or folder archive by name."""
    return F.when(F.lower(path).endswith(".nwb"), "hdf5").otherwise("zarr")
