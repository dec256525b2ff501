"""Text files next to recordings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_values(lines: DataFrame, line: str = "value", sep: str = "=") -> DataFrame:
    """(key, value) of `key=value` lines; a leading ~ is no part of the key, the first '=' separates."""
    at = F.instr(F.col(line), sep)
    rows = lines.where(at > 0)
    return rows.select(*[c for c in lines.columns if c != line], F.regexp_replace(F.trim(F.substring(F.col(line), F.lit(1), at - 1)), "^~", "").alias("key"), F.trim(F.expr(f"substring({line}, instr({line}, '{sep}') + 1)")).alias("value"))


def dash_header(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, value) of `-Key value` lines."""
    rows = lines.where(F.col(line).startswith("-"))
    return rows.select(*[c for c in lines.columns if c != line], F.regexp_extract(line, r"^-(\S+)\s*(.*)$", 1).alias("key"), F.trim(F.regexp_extract(line, r"^-(\S+)\s*(.*)$", 2)).alias("value"))


def seconds_labels(lines: DataFrame, pos: str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(onsets with labels, bad lines) of `seconds,label` lines; blank lines are neither."""
    rows = lines.where(F.trim(line) != "").withColumn("_at", F.trim(F.substring_index(line, ",", 1)).try_cast("double"))
    good = F.col("_at").isNotNull() & F.col(line).contains(",")
    label = F.trim(F.expr(f"substring({line}, instr({line}, ',') + 1)"))
    return rows.where(good).select(pos, F.col("_at").alias("onset"), label.alias("label")), rows.where(~good).select(pos, F.concat(F.lit("line "), F.col(pos).cast("string"), F.lit(" is not seconds,label")).alias("message"))


def settings_runs(text: DataFrame, column: str) -> DataFrame:
    """(name, type, value) of `NAME=..;TYPE=..;VALUE=..;` runs."""
    runs = F.explode(F.regexp_extract_all(column, F.lit(r"(NAME=[^;]*;TYPE=[^;]*;VALUE=[^;]*;)"), F.lit(1)))
    part = lambda k: F.regexp_extract("_run", rf"{k}=([^;]*);", 1)
    return text.select(*[c for c in text.columns if c != column], runs.alias("_run")).select(*[c for c in text.columns if c != column], part("NAME").alias("name"), part("TYPE").alias("type"), part("VALUE").alias("value"))


def text_table(lines: DataFrame, columns: list[str], line: str = "value") -> DataFrame:
    """Rows of a plain CSV without quoting, cells trimmed, blank lines dropped, all text."""
    cells = F.split(F.col(line), ",")
    return lines.where(F.trim(line) != "").select(*[c for c in lines.columns if c != line], *[F.trim(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)])
