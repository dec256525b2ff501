"""Spike snippets and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.operators.ranking import running_sum


def units(snippets: DataFrame, channel: str = "channel", code: str = "sort_code") -> DataFrame:
    """(channel, sort_code, unit): distinct sorted units, code 0 left out, numbered by channel then code.

    Units are few (channels times codes), so numbering them in one small window is bounded.
    """
    found = snippets.where(F.col(code) != 0).select(F.col(channel).alias("channel"), F.col(code).alias("sort_code")).distinct()
    return found.withColumn("unit", F.row_number().over(Window.orderBy("channel", "sort_code")) - 1)


def waveform_means(snippets: DataFrame, keys: list[str], waveform: str, conversion: float = 1.0) -> DataFrame:
    """(keys, n, mean array<double>): element-wise mean of the waveforms, in double.

    Positions are averaged apart and put in order again, so no task holds a unit's waveforms; the partial sums are combined
    before the shuffle.
    """
    long = snippets.select(*keys, F.posexplode(waveform).alias("_i", "_v"))
    means = long.groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"), F.count("*").alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(*keys).agg(F.max("_n").alias("n"), F.transform(ordered, lambda s: s["_m"] * conversion).alias("mean"))


def spike_times(snippets: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, times): sorted times of each unit."""
    return snippets.groupBy(*keys).agg(F.array_sort(F.collect_list(at)).alias("times"))


def ragged_index(counts: DataFrame, order: list[str], n: str) -> DataFrame:
    """counts with `end`: cumulative end offsets in order (A04), summed over ranges of the order."""
    return running_sum(counts, [F.col(c) for c in order], F.col(n), "end").withColumn("end", F.col("end") + F.col(n))


def channel_summary(snippets: DataFrame, keys: list[str], code: Column) -> DataFrame:
    """(keys, snippets, codes): snippets and distinct nonzero codes per channel."""
    return snippets.groupBy(*keys).agg(F.count("*").alias("snippets"), F.array_sort(F.collect_set(F.when(code != 0, code))).alias("codes"))


def uniform_length(snippets: DataFrame, keys: list[str], waveform: str) -> DataFrame:
    """(keys, uniform): whether all waveforms of a store have one length."""
    return snippets.groupBy(*keys).agg((F.min(F.size(waveform)) == F.max(F.size(waveform))).alias("uniform"))


def resolution(rates: DataFrame, key: str, rate: str) -> DataFrame:
    """(key, resolution): 1 / largest snippet rate."""
    return rates.groupBy(key).agg((1 / F.max(rate)).alias("resolution"))
