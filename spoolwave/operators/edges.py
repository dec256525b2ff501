"""Digital lines: transitions and high periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(words: DataFrame, key: str, at: str, word: str, bits: int = 16) -> DataFrame:
    """(key, bit, at, rising): every change of a line; a line high from the first sample rises there.

    A line that is high from the start and never changes is no digital line and has no row (W01).
    """
    order = Window.partitionBy(key).orderBy(at)
    seen = words.select(key, at, F.col(word).cast("bigint").alias("_w"), F.coalesce(F.lag(F.col(word).cast("bigint")).over(order), F.lit(0)).alias("_before"))
    changed = seen.withColumn("_x", F.col("_w").bitwiseXOR(F.col("_before"))).where("_x <> 0")
    rows = changed.select(key, at, "_w", "_x", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")).where("getbit(_x, bit) = 1")
    rows = rows.select(key, "bit", at, (F.expr("getbit(_w, bit)") == 1).alias("rising"))
    first = words.groupBy(key).agg(F.min(at).alias("_first"))
    alone = rows.groupBy(key, "bit").agg(F.count("*").alias("_n"), F.min(at).alias("_at")).join(first, key).where("_n = 1 and _at = _first").select(key, "bit")
    return rows.join(alone, [key, "bit"], "left_anti")


def periods(changes: DataFrame, keys: list[str], at: str, rising: str, end: Column | None = None) -> DataFrame:
    """(keys, onset, offset): each rise with the next fall before the next rise; otherwise it ends at `end` (W02; None: null)."""
    order = Window.partitionBy(*keys).orderBy(at, F.col(rising).cast("int"))
    nxt = changes.withColumn("_next", F.lead(at).over(order)).withColumn("_falls", ~F.lead(rising).over(order))
    offset = F.when(F.col("_falls"), F.col("_next")).otherwise(F.lit(None) if end is None else end)
    return nxt.where(rising).select(*keys, F.col(at).alias("onset"), offset.alias("offset"))


def high_periods(changes: DataFrame, keys: list[str], order: list[str], at: str, rising: str, end: Column | None = None, clamp: bool = False) -> DataFrame:
    """(keys, onset, offset) of a line that opens when low and closes when high; repeats and leading falls are ignored.

    `changes` are in `order`; only rows whose direction differs from the row before (a line starts low) change the state, so
    one lag and one lead replace the state machine. A period open at the end gets `end` (W04), at least its onset with clamp
    (W05), or null without an end (W03).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    flips = changes.withColumn("_was", F.coalesce(F.lag(rising).over(w), F.lit(False))).where(F.col(rising) != F.col("_was"))
    close = F.lead(at).over(w)
    last = F.lit(None) if end is None else (F.greatest(end, F.col(at)) if clamp else end)
    return flips.withColumn("offset", F.coalesce(close, last) if end is not None else close).where(rising).select(*keys, F.col(at).alias("onset"), "offset")


def square_edges(words: DataFrame, key: str, at: str, high: Column, step: int) -> DataFrame:
    """(key, at): rising edges of a square wave whose phases are longer than `step` samples.

    A full scan by lag: on waves within that contract it finds what sampling every `step` samples and bisecting would.
    """
    del step
    w = Window.partitionBy(key).orderBy(at)
    return words.withColumn("_high", high).withColumn("_was", F.lag("_high").over(w)).where("_high and not _was").select(key, at)
