"""Time axes: gaps, parts, epochs, offsets, continuity and rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_sections(records: DataFrame, key: str, pos: str, at: str, valid: Column, predicted: Column, tolerance: Column | int) -> DataFrame:
    """(key, section, first, last, start, samples): runs of records without a gap.

    A gap follows a record when the step to the next differs from the predicted one by more than the tolerance.
    """
    w = Window.partitionBy(key).orderBy(pos)
    step = F.col(at) - F.lag(at).over(w)
    before = F.lag(predicted).over(w)
    rows = records.withColumn("_valid", valid).withColumn("_gap", F.when(F.abs(step - before) > tolerance, 1).otherwise(0))
    rows = rows.withColumn("section", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "section").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.min_by(at, pos).alias("start"), F.sum("_valid").alias("samples"))


def parts(records: DataFrame, key: str, pos: str, at: str, limit: Column | int) -> DataFrame:
    """(key, part, start, samples): a new part begins where a record is more than `limit` after the one before."""
    w = Window.partitionBy(key).orderBy(pos)
    rows = records.withColumn("_gap", F.when(F.greatest(F.col(at) - F.lag(at).over(w), F.lit(0)) > limit, 1).otherwise(0))
    rows = rows.withColumn("part", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "part").agg(F.min_by(at, pos).alias("start"), F.count("*").alias("samples"))


def part_epochs(rows: DataFrame, key: str, order: list[str], start: Column, length: Column, slack: int) -> DataFrame:
    """rows with `epoch`: it grows where a part starts more than `slack` before the end of the part before."""
    w = Window.partitionBy(key).orderBy(*order)
    cut = rows.withColumn("_start", start).withColumn("_end", start + length)
    reset = F.when(F.col("_start") + slack < F.lag("_end").over(w), 1).otherwise(0)
    return cut.withColumn("_reset", reset).withColumn("epoch", F.sum("_reset").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start", "_end", "_reset")


def clock_epochs(packets: DataFrame, key: str, pos: str, ticks: str, second: int, restart: str | None = None) -> DataFrame:
    """(key, pos, ticks, epoch): clock epochs of packets.

    An epoch begins where a tick is over a second below the largest of the epoch so far, or at a restart message (which is no
    packet itself). The running maximum starts anew inside the scan, which no window frame can say, so each file is scanned
    in order; a task holds one file's packet index (positions and ticks, not payloads).
    """
    flag = F.col(restart) if restart else F.lit(False)
    cut = packets.select(key, F.col(pos).cast("bigint").alias(pos), F.col(ticks).cast("bigint").alias(ticks), flag.alias("_restart"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        epoch = last = kept = 0
        out, keep = [], []
        for t, again in zip(pdf[ticks].tolist(), pdf["_restart"].tolist()):
            if kept and (t + second < last or again):
                epoch, last = epoch + 1, t
            last = max(last, t)
            out.append(epoch)
            keep.append(not again)
            kept += not again
        return pdf.assign(epoch=out)[keep][[key, pos, ticks, "epoch"]]

    kind = dict(packets.dtypes)[key]
    return cut.groupBy(key).applyInPandas(scan, f"{key} {kind}, {pos} bigint, {ticks} bigint, epoch bigint")


def measured_rate(sections: DataFrame, records: DataFrame, key: str, pos: str, at: str, valid: Column) -> DataFrame:
    """(key, rate): samples per second of the longest section by records, the last of equals (A13); null for one record."""
    longest = sections.groupBy(key).agg(F.max_by(F.struct("first", "last", "start", "samples"), F.struct(F.col("last") - F.col("first"), F.col("first"))).alias("s"))
    tail = records.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.col(at).alias("_at"), valid.alias("_v"))
    joined = longest.join(tail, (F.col(key) == F.col("_k")) & (F.col("s.last") == F.col("_p")))
    return joined.select(key, F.when(F.col("s.last") != F.col("s.first"), (F.col("s.samples") - F.col("_v")) * 1e6 / (F.col("_at") - F.col("s.start"))).alias("rate"))


def regular_rate(events: DataFrame, key: str, at: str) -> DataFrame:
    """(key, start, rate) of evenly spaced series: three or more times within 0.01 % of the mean step, else rate null."""
    spread = events.groupBy(key).agg(F.min(at).alias("_t0"), F.max(at).alias("_t1"), F.count("*").alias("_n"))
    steps = events.select(key, (F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at))).alias("_step")).where("_step is not null")
    steps = steps.groupBy(key).agg(F.min("_step").alias("_least"), F.max("_step").alias("_most"))
    mean = (F.col("_t1") - F.col("_t0")) / (F.col("_n") - 1)
    even = (F.col("_n") >= 3) & (mean > 0) & (F.greatest(F.col("_most") - mean, mean - F.col("_least")) <= mean * 1e-4)
    return spread.join(steps, key, "left").select(key, F.col("_t0").alias("start"), F.when(even, 1 / mean).alias("rate"))


def out_of_order(rows: DataFrame, key: str, pos: str, at: str) -> DataFrame:
    """(key, backwards): number of rows earlier than the row before."""
    w = Window.partitionBy(key).orderBy(pos)
    late = rows.select(key, (F.lag(at).over(w) > F.col(at)).alias("_late"))
    return late.groupBy(key).agg(F.count(F.when(F.col("_late"), 1)).alias("backwards"))


def continuity(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, first, last, n, missing): numbers that a gap-free run would also hold."""
    g = rows.groupBy(key).agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
    return g.withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("n"))


def contiguous(rows: DataFrame, key: str, number: str, step: int) -> DataFrame:
    """(key, contiguous, backwards): whether all steps equal `step`, and whether any goes back."""
    w = Window.partitionBy(key).orderBy("_pos")
    cut = rows.withColumn("_d", F.col(number) - F.lag(number).over(w))
    return cut.groupBy(key).agg(F.coalesce(F.bool_and(F.col("_d") == step), F.lit(True)).alias("contiguous"), F.coalesce(F.bool_or(F.col("_d") < 0), F.lit(False)).alias("backwards"))


def consecutive_distinct(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before in their key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_was", F.lag(value).over(w)).where("_was is null or not (_was <=> " + value + ")").drop("_was")


def ordinal_names(rows: DataFrame, by: list[str], order: list[str], base: Column, first_plain: bool = True) -> DataFrame:
    """rows with `name`: the base, numbered within `by` (W20: from the second on; W23: .p1 .. when there are several)."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(*order))
    if first_plain:
        name = F.when(k == 1, base).otherwise(F.concat(base, F.lit("_"), k.cast("string")))
    else:
        name = F.when(F.count("*").over(w) == 1, base).otherwise(F.concat(base, F.lit(".p"), k.cast("string")))
    return rows.withColumn("name", name)
