"""Pairing of event stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_offsets(onsets: DataFrame, offsets: DataFrame, key: str, at: str, end: Column) -> DataFrame:
    """(key, pos, onset, offset): the n-th onset with the n-th offset of its store.

    One offset too few: the last onset closes at `end`. Any other difference: the offsets are dropped.
    """
    w = Window.partitionBy(key).orderBy(at)
    a = onsets.select(key, F.col(at).alias("onset"), F.row_number().over(w).alias("pos"), F.count("*").over(Window.partitionBy(key)).alias("_on"))
    b = offsets.select(F.col(key).alias("_key"), F.col(at).alias("_off"), F.row_number().over(w).alias("_pos"), F.count("*").over(Window.partitionBy(key)).alias("_m"))
    counts = b.select("_key", "_m").distinct()
    rows = a.join(counts, F.col(key) == F.col("_key"), "left").drop("_key").join(b.drop("_m"), (F.col(key) == F.col("_key")) & (F.col("pos") == F.col("_pos")), "left")
    m = F.coalesce("_m", F.lit(0))
    offset = F.when(m == F.col("_on"), F.col("_off")).when(m + 1 == F.col("_on"), F.coalesce(F.col("_off"), end))
    return rows.select(key, "pos", "onset", offset.alias("offset"))


def attach_labels(events: DataFrame, notes: DataFrame, key: str, event_order: list[str], note_order: list[str], label: str) -> DataFrame:
    """events with `label`: the n-th note of a key labels its n-th event, empty beyond."""
    a = events.withColumn("_pos", F.row_number().over(Window.partitionBy(key).orderBy(*event_order)))
    b = notes.select(F.col(key).alias("_key"), F.row_number().over(Window.partitionBy(key).orderBy(*note_order)).alias("_n"), F.col(label).alias("_label"))
    return a.join(b, (F.col(key) == F.col("_key")) & (F.col("_pos") == F.col("_n")), "left").withColumn("label", F.coalesce("_label", F.lit(""))).drop("_pos", "_key", "_n", "_label")


def preferred(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, and the rows of second whose key first does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def overlay_codes(rows: DataFrame, codes: DataFrame, key: str, code: str, into: str) -> DataFrame:
    """rows with `into`: the overlay's code where it has one, else the row's own."""
    return rows.join(codes.select(key, F.col(code).alias("_over")), key, "left").withColumn(into, F.coalesce("_over", into)).drop("_over")


def scalar_rows(records: DataFrame, key: str, order: list[str], at: str, channel: str, value: str, channels: int) -> DataFrame:
    """(key, row, at, values): neighbouring records of one time become a row of channel values, NaN where missing.

    A time that comes again later is a new row; of repeated channels the last wins; channels outside 1..n are clamped.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = records.withColumn("_new", F.when(F.lag(at).over(w).eqNullSafe(F.col(at)), 0).otherwise(1)).withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_c", F.greatest(F.lit(1), F.least(F.lit(channels), F.col(channel)))).withColumn("_pos", F.struct(*order))
    cells = [F.coalesce(F.max_by(F.when(F.col("_c") == c, F.col(value)), F.when(F.col("_c") == c, F.col("_pos"))), F.lit(float("nan"))) for c in range(1, channels + 1)]
    return rows.groupBy(key, "row").agg(F.min(at).alias("at"), F.array(*cells).alias("values"))


def after_midnight(clock: Column, start: Column) -> Column:
    """Seconds of a day that lie on the next day if before the start."""
    return F.when(clock < start, clock + 86400).otherwise(clock) - start
