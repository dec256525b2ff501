"""Clocks and time joins: nearest matches, line fits, range lookups, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: float | int | None = None) -> DataFrame:
    """(key, at, near): for each left time the nearest right time of its key, the earlier of equals; none farther than tolerance.

    Both sides are laid on one time axis per key; the last right time before comes from a frame that runs up the axis and the
    first after from one that runs down it. Both grow row by row, so the cost is two sorts however far apart matches are (a
    frame up to the following end would be evaluated anew for every row). Ties at the same instant count as distance 0.
    """
    axis = left.select(key, F.col(at).alias("_t"), F.lit(None).cast(dict(right.dtypes)[at]).alias("_r")).unionByName(right.select(key, F.col(at).alias("_t"), F.col(at).alias("_r")))
    last = lambda t: F.last("_r", ignorenulls=True).over(Window.partitionBy(key).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = last(F.col("_t").asc()), last(F.col("_t").desc())
    both = axis.withColumn("_b", before).withColumn("_a", after).where("_r is null")
    near = F.when(F.col("_a").isNull() | (F.col("_t") - F.col("_b") <= F.col("_a") - F.col("_t")), F.col("_b")).otherwise(F.col("_a"))
    out = both.select(key, F.col("_t").alias(at), near.alias("near")).where("near is not null")
    return out if tolerance is None else out.where(F.abs(F.col("near") - F.col(at)) <= tolerance)


def clock_fit(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, scale, offset, edges, residual): least squares y = scale x + offset; no row with fewer than two distinct times.

    Sums are taken about the means, so large clock values lose no digits.
    """
    mean = pairs.groupBy(key).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count("*").alias("edges"))
    dev = pairs.join(mean, key).select(key, "_mx", "_my", "edges", (F.col(x) - F.col("_mx")).alias("_dx"), (F.col(y) - F.col("_my")).alias("_dy"))
    sums = dev.groupBy(key, "_mx", "_my", "edges").agg(F.sum(F.col("_dx") * F.col("_dx")).alias("_sxx"), F.sum(F.col("_dx") * F.col("_dy")).alias("_sxy")).where("edges >= 2 and _sxx > 0")
    fit = sums.select(key, "edges", (F.col("_sxy") / F.col("_sxx")).alias("scale"), "_mx", "_my")
    resid = dev.drop("edges", "_mx", "_my").join(fit, key).groupBy(key, "edges", "scale", "_mx", "_my").agg(F.max(F.abs(F.col("_dy") - F.col("scale") * F.col("_dx"))).alias("residual"))
    return resid.select(key, "scale", (F.col("_my") - F.col("scale") * F.col("_mx")).alias("offset"), "edges", "residual")


def apply_clock(t: Column, scale: Column, offset: Column) -> Column:
    """Reference time of a stream time."""
    return scale * t + offset


def range_lookup(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, keep: list[str]) -> DataFrame:
    """points with the columns `keep` of the last range of their key that starts at or before them.

    Ranges and points share one axis per key and the range's columns are carried forward, which replaces a range join.
    """
    cols = [c for c in points.columns if c != key]
    a = points.select(key, F.col(at).alias("_t"), F.struct(*cols).alias("_p"), F.lit(None).cast(ranges.select(F.struct(*keep)).schema[0].dataType).alias("_g"))
    b = ranges.select(key, F.col(start).alias("_t"), F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), F.struct(*keep).alias("_g"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("_found", F.last("_g", ignorenulls=True).over(w)).where("_p is not null and _found is not null")
    return out.select(key, "_p.*", *[F.col(f"_found.{c}").alias(c) for c in keep])


def markers(events: DataFrame, key: str, at: str, start: float, span: float, most: int = 2000) -> DataFrame:
    """(key, at, position): onsets in [start, start + span) as shares of the window, the first `most` of each key."""
    inside = events.where((F.col(at) >= start) & (F.col(at) < start + span))
    w = Window.partitionBy(key).orderBy(at)
    return inside.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(key, at, ((F.col(at) - start) / span).alias("position"))


def inside_segments(events: DataFrame, segments: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """events with `inside`: whether any segment [start, end] of their key holds them, ends included.

    The largest end among segments that start at or before a time decides, so a running maximum replaces the interval join.
    """
    axis = events.select(key, F.col(at).alias("_t"), F.lit(None).cast(dict(segments.dtypes)[end]).alias("_e"), F.struct(*events.columns).alias("_row"))
    opens = segments.select(key, F.col(start).alias("_t"), F.col(end).alias("_e"), F.lit(None).cast(axis.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = axis.unionByName(opens).withColumn("_reach", F.max("_e").over(w)).where("_row is not null")
    return reach.select("_row.*", F.coalesce(F.col("_reach") >= F.col("_t"), F.lit(False)).alias("inside"))


def common_range(rows: DataFrame, group: str, first: str, end: str) -> DataFrame:
    """(group, first, end): intersection of the ranges of a group; empty ones have end <= first."""
    return rows.groupBy(group).agg(F.max(first).alias("first"), F.min(end).alias("end"))
