"""Signals: channel projection, calibration, windows, min/max envelopes and storage choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(signal: DataFrame, sample: str = "sample", values: str = "values", keep: Sequence[str] = ()) -> DataFrame:
    """A row per sample and channel: (sample, channel, value double)."""
    return signal.select(*keep, F.col(sample).alias("sample"), F.posexplode(values).alias("channel", "value")).withColumn("value", F.col("value").cast("double"))


def channels(signal: DataFrame, wanted: Sequence[int], values: str = "values") -> DataFrame:
    """The wanted channels of an array signal, in the order given."""
    return signal.withColumn(values, F.array(*[F.element_at(values, c + 1) for c in wanted]))


def sample_range(rate: Column, start: Column, span: Column, samples: Column) -> tuple[Column, Column]:
    """First and end sample of a time window: at least one sample, inside the recording."""
    first = F.least(F.floor(F.greatest(start, F.lit(0.0)) * F.greatest(rate, F.lit(1e-9))), samples)
    return first, F.least(first + F.floor(F.greatest(span * rate, F.lit(1.0))), samples)


def fetch_range(start: Column, span: Column) -> tuple[Column, Column]:
    """Start and length of the three windows around a view, on the grid of window lengths."""
    return F.greatest((F.floor(start / span) - 1) * span, F.lit(0.0)), 3 * span


def calibrated(raw: Column, gain: Column, offset: Column) -> Column:
    """(stored * gain + offset) in double, then float."""
    return (raw.cast("double") * gain + offset).cast("float")


def envelope(signal: DataFrame, start: int, end: int, columns: int, sample: str = "sample", values: str = "values") -> DataFrame:
    """(channel, column, lo, hi): least and largest value of each channel in each of `columns` equal parts of [start, end).

    A range of fewer samples than columns has a column per sample; NaN is skipped. The range reaches the scan as a predicate,
    and the aggregate is combined before the shuffle to at most channels x columns rows a task.
    """
    n = end - start
    if n <= 0:
        columns = 1
    columns = min(columns, max(n, 1))
    part = signal.where((F.col(sample) >= start) & (F.col(sample) < end))
    rows = long_form(part, sample, values).where(~F.isnan("value"))
    column = F.expr(f"(sample - {start}L) * {columns}L div {max(n, 1)}L")
    return rows.groupBy("channel", column.alias("column")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def resample(lanes: DataFrame, lane_columns: int, first: int, end: int, rate: float, start: float, span: float, columns: int) -> DataFrame:
    """(channel, column, lo, hi) of a view cut out of an envelope of [first, end) with `lane_columns` columns.

    View columns outside the envelope have no row. The bins of the view are a table of `columns` rows, joined by range.
    """
    length = float(end - first)
    views = lanes.sparkSession.range(columns).select(F.col("id").alias("view"), ((start + F.col("id") * span / columns) * rate - first).alias("s0"))
    views = views.withColumn("s1", F.col("s0") + span / columns * rate).where((F.col("s1") > 0) & (F.col("s0") < length))
    low = F.greatest(F.floor(F.col("s0") / length * lane_columns), F.lit(0))
    high = F.least(F.greatest(F.least(F.ceil(F.col("s1") / length * lane_columns), F.lit(lane_columns)), low + 1), F.lit(lane_columns))
    cover = views.select("view", F.explode(F.sequence(low, high - 1)).alias("column"))
    return lanes.join(F.broadcast(cover), "column").groupBy("channel", F.col("view").alias("column")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def peak(lanes: DataFrame) -> DataFrame:
    """(peak): largest magnitude over an envelope's finite cells, 0 without any."""
    finite = lambda c: F.abs(c) < F.lit(float("inf"))
    return lanes.where(finite("lo") & finite("hi") & ~F.isnan("lo") & ~F.isnan("hi")).agg(F.coalesce(F.max(F.greatest(F.abs("lo"), F.abs("hi"))), F.lit(0.0)).alias("peak"))


def storage_choice(channel_rows: DataFrame, recording: str, gain: str, offset: str, electrical: Column, stored_as: Column) -> DataFrame:
    """(recording, storage, gain): how a recording's samples are kept.

    Any offset or float32 source: float32. One gain: the stored type, gain folded in. Several gains: the stored type with a
    factor per channel if electrical, else float32.
    """
    g = channel_rows.groupBy(recording).agg(
        F.min(gain).alias("_low"), F.max(gain).alias("_high"), F.max(F.when(F.col(offset) != 0, 1).otherwise(0)).alias("_offset"), F.max(electrical).alias("_electrical"), F.max(stored_as).alias("_stored")
    )
    plain = (F.col("_offset") == 1) | (F.col("_stored") == "float32")
    kind = F.when(plain, "float32").when(F.col("_low") == F.col("_high"), F.concat("_stored", F.lit("_folded"))).when(F.col("_electrical"), F.concat("_stored", F.lit("_per_channel"))).otherwise("float32")
    return g.select(recording, kind.alias("storage"), F.when(~plain & (F.col("_low") == F.col("_high")), F.col("_low")).alias("gain"))


def truncated_to_shortest(rows: DataFrame, store: str, channel: str, position: str) -> DataFrame:
    """Rows of each store up to the length of its shortest channel (A17); position counts from 0 in a channel."""
    lengths = rows.groupBy(store, channel).agg(F.count("*").alias("_n")).groupBy(store).agg(F.min("_n").alias("_shortest"))
    return rows.join(lengths, store).where(F.col(position) < F.col("_shortest")).drop("_shortest")
