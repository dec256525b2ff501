"""Numeric and bit functions (N01-N25). Everything stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack_high(w: Column) -> Column:
    """Upper 16 bits of a packed 32-bit word, signed."""
    return F.shiftright(w.cast("int"), 16)


def unpack_low(w: Column) -> Column:
    """Lower 16 bits of a packed word, signed."""
    return w.cast("bigint").bitwiseAND(F.lit(65535)).bitwiseXOR(F.lit(32768)) - 32768


def offset_binary(raw: Column) -> Column:
    """Unsigned 16-bit with its zero in the middle."""
    return raw - 32768


def stim_word(raw: Column) -> Column:
    """Magnitude in bits 0-7, sign in bit 8."""
    size = raw.bitwiseAND(F.lit(255))
    return F.when(raw.bitwiseAND(F.lit(256)) != 0, -size).otherwise(size)


def bit(w: Column, n: int) -> Column:
    """Bit n of a word."""
    return F.shiftright(w, n).bitwiseAND(F.lit(1))


def snapped(dt: Column, clock: float = 195312.5) -> Column:
    """Seconds on the device clock's grid, after removing float noise below 1e-9 ticks."""
    return F.round(F.round(dt * clock * 1e9) / 1e9) / clock


def volts_per_bit(volt_range: Column, max_int: Column, default: int = 512) -> Column:
    """Range over the largest integer."""
    return volt_range / F.coalesce(max_int, F.lit(default))


def linear_scale(max_analog: Column, min_analog: Column, max_digital: Column, min_digital: Column) -> tuple[Column, Column]:
    """Gain and offset that map the digital to the analog range; null for an empty range."""
    span = F.nullif(max_digital - min_digital, F.lit(0))
    gain = (max_analog - min_analog) / span
    return gain, min_analog - min_digital * gain


def unit_factor(unit: Column) -> Column:
    """Volts per unit by name; null if unknown."""
    return F.when(unit == "V", 1.0).when(unit == "mV", 1e-3).when(unit.isin("uV", "µV"), 1e-6).when(unit == "nV", 1e-9)


def inverted_gain(gain: Column, inverted: Column) -> Column:
    """Gain with its sign turned for inverted input."""
    return gain * F.when(inverted, -1).otherwise(1)


def impedance_factor(column: Column) -> Column:
    """Ohms per unit from a column's name."""
    return F.when(column.endswith("(kOhm)"), 1e3).when(column.endswith("(MOhm)"), 1e6).otherwise(1.0)


def nice_step(span: Column, least: int) -> Column:
    """Largest 1-2-5 step with at least that many ticks in the span."""
    raw = span / max(least, 1)
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(10.0 * size <= raw, 10.0 * size).when(5.0 * size <= raw, 5.0 * size).when(2.0 * size <= raw, 2.0 * size).otherwise(size)
    return F.when(F.isnan(span) | (span <= 0), 1.0).otherwise(step)


def tick_range(start: Column, end: Column, step: Column) -> tuple[Column, Column]:
    """Numbers of the first and last tick."""
    return F.ceil(start / step), F.floor(end / step)


#: SI prefixes.
SI = ((1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "µ"), (1e-9, "n"))


def si_scale(value: Column) -> tuple[Column, Column]:
    """Value over its SI prefix, and the prefix."""
    size = F.abs(value)
    scale, prefix = F.lit(1e-9), F.lit("n")
    for s, p in reversed(SI):
        scale, prefix = F.when(size >= s * 0.999999, s).otherwise(scale), F.when(size >= s * 0.999999, p).otherwise(prefix)
    plain = (value == 0) | F.isnan(value)
    return F.when(plain, value).otherwise(value / scale), F.when(plain, "").otherwise(prefix)


def ticks_to_seconds(ticks: Column, zero: Column, rate: Column) -> Column:
    """Seconds since a zero tick; integers are subtracted first."""
    return (ticks - zero) / rate


def waveform_width(packet_bytes: Column, header_bytes: Column, sample_bytes: Column, stated: Column) -> Column:
    """Samples in a packet: stated, or what fits."""
    return F.when(stated > 0, stated).otherwise(F.floor((packet_bytes - header_bytes) / sample_bytes))


def progress(done: Column, total: Column, elapsed: Column) -> tuple[Column, Column]:
    """Percent done and seconds left."""
    return 100.0 * done / total, F.when(done > 0, elapsed * (total - done) / done)
