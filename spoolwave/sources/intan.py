"""RHD and RHS headers and their three layouts."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from spoolwave.sources import stretches
from spoolwave.sources.files import file_system

# Magic numbers, signal types, volts per bit.
RHD, RHS = 0xC6912702, 0xD69127AC
SIGNALS = {
    RHD: {0: "amplifier", 1: "aux", 2: "supply", 3: "adc", 4: "digital_in", 5: "digital_out"},
    RHS: {0: "amplifier", 3: "adc", 4: "dac", 5: "digital_in", 6: "digital_out"},
}
GAIN = {"amplifier": 0.195e-6, "aux": 37.4e-6, "supply": 74.8e-6, "dac": 312.5e-6}
RHD_ADC = {1: (152.59e-6, True), 13: (312.5e-6, True)}
#: Names of the files of the one-file-per-type layout.
PER_TYPE = {"amplifier": "amplifier.dat", "aux": "auxiliary.dat", "supply": "supply.dat", "adc": "analogin.dat", "dac": "analogout.dat"}


@dataclass
class Header:
    kind: int
    version: tuple[int, int]
    rate: float
    temp_sensors: int = 0
    board_mode: int = 0
    dc_saved: bool = False
    stim_step: float = 0.0
    notes: list[str] = field(default_factory=list)
    reference: str = ""
    channels: list[dict] = field(default_factory=list)
    size: int = 0

    @property
    def block(self) -> int:
        return 60 if self.kind == RHD and self.version < (2, 0) else 128

    def of(self, signal: str) -> list[dict]:
        return [c for c in self.channels if c["signal"] == signal]


class _Cursor:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, code: str):
        s = struct.Struct("<" + code)
        if self.at + s.size > len(self.raw):
            raise ValueError("the header ends early")
        got = s.unpack_from(self.raw, self.at)
        self.at += s.size
        return got[0] if len(got) == 1 else got

    def text(self) -> str:
        n = self.take("I")
        if n in (0, 0xFFFFFFFF):
            return ""
        if n % 2 or n > 1 << 20 or self.at + n > len(self.raw):
            raise ValueError(f"bad string length {n} in the header")
        self.at += n
        return self.raw[self.at - n : self.at].decode("utf-16-le", "replace")


def parse(raw: bytes) -> Header:
    """The header of a file (S35); fields depend on kind and version."""
    c = _Cursor(raw)
    kind = c.take("I")
    if kind not in SIGNALS:
        raise ValueError("not an RHD or RHS file")
    rhs = kind == RHS
    h = Header(kind, c.take("hh"), c.take("f"))
    c.take("hff")  # high-pass filter: on, cut-off, lower bandwidth
    if rhs:
        c.take("f")
    c.take("f")
    c.take("4f" if rhs else "3f")
    c.take("hff")  # notch, impedance test
    if rhs:
        c.take("hh")
        h.stim_step = c.take("f")
        c.take("ff")
    h.notes = [n for n in (c.text() for _ in range(3)) if n.strip()]
    if rhs:
        h.dc_saved, h.board_mode, h.reference = c.take("h") != 0, c.take("h"), c.text()
    else:
        h.temp_sensors = max(c.take("h"), 0) if h.version >= (1, 1) else 0
        h.board_mode = c.take("h") if h.version >= (1, 3) else 0
        h.reference = c.text() if h.version >= (2, 0) else ""
    for _ in range(max(c.take("h"), 0)):
        _, prefix = c.text(), c.text()
        enabled, count, _ = c.take("hhh")
        for _ in range(count if enabled else 0):
            native, custom = c.text(), c.text()
            order, _, signal, on, _ = c.take("5h")
            c.take("h" if not rhs else "hh")
            c.take("4h")
            ohms, _ = c.take("ff")
            if signal not in SIGNALS[kind]:
                raise ValueError(f"channel {native}: unknown signal type {signal}")
            if on:
                h.channels.append({"native": native, "name": custom or native, "order": max(order, 0), "signal": SIGNALS[kind][signal], "group": prefix or "board", "ohms": ohms})
    h.size = c.at
    return h


def scale(h: Header, signal: str, traditional: bool) -> tuple[str, float, float]:
    """Stored type, gain and shift of a signal (N11, N24): offset-binary ones are shifted by half their range."""
    offset = False
    gain = GAIN.get(signal, 1.0)
    if signal == "amplifier":
        offset = traditional
        if not traditional:
            return "<i2", gain, 0.0
    elif signal == "adc":
        gain, offset = (312.5e-6, True) if h.kind == RHS else RHD_ADC.get(h.board_mode, (50.354e-6, False))
    elif signal == "dac":
        offset = True
    return "<u2", gain, -32768 * gain if offset else 0.0


def fields(h: Header) -> tuple[list[tuple[str, int, int, int]], int]:
    """(signal, channels, samples per block, byte in the block) in file order, and the block's bytes."""
    b, n = h.block, lambda s: len(h.of(s))
    plan = [("amplifier", n("amplifier"), b)]
    if h.kind == RHD:
        plan += [("aux", n("aux"), b // 4), ("supply", n("supply"), 1), ("temperature", h.temp_sensors, 1)]
    else:
        plan += [("dc", n("amplifier") if h.dc_saved else 0, b), ("stim", n("amplifier"), b)]
    plan.append(("adc", n("adc"), b))
    if h.kind == RHS:
        plan.append(("dac", n("dac"), b))
    plan += [("digital_in", min(n("digital_in"), 1), b), ("digital_out", min(n("digital_out"), 1), b)]
    out, at = [], 4 * b
    for signal, count, per in plan:
        if count:
            out.append((signal, count, per, at))
        at += 2 * count * per
    return out, at


def traditional_stretches(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """Stretches of a block file: a stretch per signal and block run, channels behind each other inside a block."""
    fs, where = file_system(path)
    with fs.open_input_file(where) as f:
        raw = f.read(min(fs.get_file_info(where).size, 8 << 20))
    h = parse(raw)
    plan, size = fields(h)
    blocks = (fs.get_file_info(where).size - h.size) // size
    rows = []
    for signal, count, per, at in plan:
        dtype, gain, shift = scale(h, signal, True) if signal not in ("temperature", "dc", "stim", "digital_in", "digital_out") else ("<u2", 0.01 if signal == "temperature" else 1.0, 0.0)
        for k in range(blocks):
            rows.append(stretches.stretch(signal, path, per, h.size + k * size + at, dtype, 2, [2 * per * c for c in range(count)], None, [gain] * count, [shift] * count, first=k * per))
    return stretches.table(spark, rows), h


def per_type_stretches(spark: SparkSession, folder: str, h: Header) -> DataFrame:
    """Stretches of the one-file-per-type layout; missing files are left out."""
    rows = []
    for signal, name in PER_TYPE.items():
        n = len(h.of(signal))
        fs, where = file_system(f"{folder}/{name}")
        info = fs.get_file_info(where)
        if n and info.is_file:
            dtype, gain, shift = scale(h, signal, False)
            rows.append(stretches.stretch(signal, f"{folder}/{name}", info.size // (2 * n), 0, dtype, 2 * n, [2 * c for c in range(n)], None, [gain] * n, [shift] * n))
    return stretches.table(spark, rows)


def per_channel_stretches(spark: SparkSession, folder: str, h: Header) -> tuple[DataFrame, list[str]]:
    """Stretches of the one-file-per-channel layout, and the names of missing files."""
    prefix = {"amplifier": "amp-", "aux": "aux-", "supply": "vdd-", "adc": "board-", "dac": "board-"}
    rows, missing = [], []
    for signal in prefix:
        for k, c in enumerate(h.of(signal)):
            name = f"{prefix[signal]}{c['native']}.dat"
            fs, where = file_system(f"{folder}/{name}")
            info = fs.get_file_info(where)
            if info.is_file:
                dtype, gain, shift = scale(h, signal, False)
                rows.append(stretches.stretch(signal, f"{folder}/{name}", info.size // 2, 0, dtype, 2, [0], [k], [gain], [shift]))
            else:
                missing.append(name)
    return stretches.table(spark, rows), missing
