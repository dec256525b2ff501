"""Runs of .bin and .meta files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spoolwave.sources import stretches
from spoolwave.sources.files import file_system, listing


@dataclass(frozen=True)
class Name:
    run: str
    trigger: str | None
    stream: str | None
    band: str | None


def parse_name(file: str) -> Name | None:
    """Run, trigger, stream and band of a .meta file's name."""
    if not file.lower().endswith(".meta"):
        return None
    parts = file[:-5].split(".")
    band = parts.pop() if parts[-1] in ("ap", "lf") else None
    if len(parts) > 2 and parts[-1] == "obx":
        parts.pop()
    stream = parts.pop() if len(parts) > 1 and re.fullmatch(r"nidq|imec\d*|obx\d+", parts[-1]) else None
    run = ".".join(parts)
    m = re.fullmatch(r"(.*)_t(\d+|cat)", run)
    return Name(m[1] if m else run, m[2] if m else None, "imec0" if stream == "imec" else stream, band)


def trigger_order(trigger: str | None) -> tuple:
    """None first, numbers by value, cat last."""
    return (0, 0) if trigger is None else (2, 0) if trigger == "cat" else (1, int(trigger))


def meta(path: str) -> dict[str, str]:
    """key=value lines, ~ taken off the keys; nSavedChans must be there."""
    fs, where = file_system(path)
    with fs.open_input_file(where) as f:
        lines = f.read().decode("utf-8", "replace").splitlines()
    out = {k.strip().lstrip("~"): v.strip() for k, sep, v in (line.partition("=") for line in lines) if sep}
    if "nSavedChans" not in out:
        raise ValueError(f"{path}: no nSavedChans")
    return out


def runs(path: str) -> dict[str, list[tuple[Name, str]]]:
    """Meta files of each run, in trigger order."""
    _, found = listing(path, ".meta")
    out: dict[str, list[tuple[Name, str]]] = {}
    for i in found:
        if name := parse_name(i.base_name):
            out.setdefault(name.run, []).append((name, i.path))
    return {r: sorted(v, key=lambda x: (trigger_order(x[0].trigger), x[0].stream or "", x[0].band or "")) for r, v in out.items()}


def saved_channels(s: str | None, n: int) -> list[int]:
    """Acquired numbers of the saved channels: 'all', or numbers and inclusive ranges."""
    if not s or s == "all":
        return list(range(n))
    ends = [p.split(":") for p in s.split(",")]
    return [c for e in ends for c in range(int(e[0]), int(e[-1]) + 1)]


def volts_per_bit(m: dict[str, str]) -> float:
    """Range over largest integer: 512 unless stated for probes, 32768 for others."""
    probe = m.get("typeThis", "imec") == "imec"
    top = float(m["imAiRangeMax" if probe else "niAiRangeMax"])
    return top / float(m.get("imMaxInt" if probe else "niMaxInt", 512 if probe else 32768))


def probe_gains(m: dict[str, str], band: str | None) -> dict[int, float] | None:
    """Gain per channel from the probe's table, a uniform one, or 80 for the fixed-gain types; None if unknown."""
    table = re.findall(r"\(([^)]*)\)", m.get("imroTbl", ""))
    kind = table[0].split(",")[0] if table else m.get("imDatPrb_type", "0")
    if kind in ("21", "24", "2003", "2004", "2013", "2014"):
        return {i: 80.0 if kind in ("21", "24") else 100.0 for i in range(len(table) - 1)}
    if f"imChan0{'lf' if band == 'lf' else 'ap'}Gain" in m:
        return {i: float(m[f"imChan0{'lf' if band == 'lf' else 'ap'}Gain"]) for i in range(max(len(table) - 1, 1))}
    rows = [r.split() for r in table[1:]]
    if rows and all(len(r) >= 5 for r in rows):
        return {int(r[0]): float(r[4 if band == "lf" else 3]) for r in rows}
    return None


def sites(m: dict[str, str]) -> list[tuple[int, float, float]]:
    """(shank, x, y) in micrometres of each channel from the geometry map."""
    rows = [r.split(":") for r in re.findall(r"\(([^)]*)\)", m.get("snsGeomMap", ""))]
    if rows:
        pitch = float(rows[0][0].split(",")[2]) if rows[0][0].count(",") >= 2 else 0.0
        return [(int(s), int(s) * pitch + float(x), float(y)) for s, x, y, *_ in rows[1:]]
    shank = [r.split(":") for r in re.findall(r"\(([^)]*)\)", m.get("snsShankMap", ""))]
    return [(int(s), 32.0 * int(c), 20.0 * int(r)) for s, c, r, *_ in shank[1:]]


def run_stretches(spark: SparkSession, path: str) -> DataFrame:
    """Stretches of all files of all runs under a path: analog columns in volts, the sync column raw."""
    rows = []
    for found in runs(path).values():
        for name, where in found:
            prefix = "file://" if not path.startswith("file://") and "://" not in path else path[: path.index("://") + 3] if "://" in path else ""
            m = meta(prefix + where)
            saved = int(m["nSavedChans"])
            fs, bin_path = file_system(prefix + where[:-5] + ".bin")
            size = fs.get_file_info(bin_path).size
            acquired = saved_channels(m.get("snsSaveChanSubset"), saved)
            gains = probe_gains(m, name.band) if m.get("typeThis", "imec") == "imec" else {}
            volts = volts_per_bit(m)
            digital = int(m.get("snsApLfSy", m.get("snsMnMaXaDw", "0,0,0,0")).split(",")[-1])
            known = gains is not None
            label = ".".join(x for x in (f"{name.run}_t{name.trigger}" if name.trigger else name.run, name.stream, name.band) if x)
            scale = [1.0 if i >= saved - digital or not known else volts / gains.get(a % max(len(gains), 1), 1.0) for i, a in enumerate(acquired)]
            rows.append(stretches.stretch(label, prefix + where[:-5] + ".bin", size // (2 * saved), 0, "<i2", 2 * saved, [2 * i for i in range(saved)], acquired, scale))
    return stretches.table(spark, rows)
