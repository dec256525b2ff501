"""Ranks and running sums over a whole table, with no task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.sources.files import checkpoint

#: Ranges for each shuffle partition: ranges meet in tasks by hash, and many small ones even out.
RANGES = 4


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str, ranges: int | None = None) -> DataFrame:
    """df with `out`: the sum of `value` over all rows before this one in the stated order (nulls as the order says; null values
    count as 0).

    Rows are dealt by sampled ranges of the order, each range is summed alone, and the ranges' totals (one row each) are summed
    and joined back. Rows that tie in the order follow by a digest of all their columns; rows that are equal in all of them are
    interchangeable and are dealt over ranges too, so that a value that most rows hold is no single task. The dealt rows are
    checkpointed once: bounds are sampled, and a second sample would be another dealing. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ranges = ranges or RANGES * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    told = df.select("*", F.coalesce(value.cast("bigint"), F.lit(0)).alias("_rank_value"), F.xxhash64(*plain).alias("_rank_tie"), F.monotonically_increasing_id().alias("_rank_row"))
    dealt = checkpoint(told.repartitionByRange(ranges, *order, "_rank_tie", "_rank_row").withColumn("_rank_range", F.spark_partition_id()))
    totals = dealt.groupBy("_rank_range").agg(F.sum("_rank_value").alias("_rank_total"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row a range: as many as there are ranges, whatever the table
    ahead = totals.select("_rank_range", F.coalesce(F.sum("_rank_total").over(before.orderBy("_rank_range")), F.lit(0)).alias("_rank_ahead"))
    within = Window.partitionBy("_rank_range").orderBy(*order, "_rank_tie", "_rank_row").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_rank_within", F.coalesce(F.sum("_rank_value").over(within), F.lit(0)))
    return own.join(F.broadcast(ahead), "_rank_range").select(*df.columns, (F.col("_rank_ahead") + F.col("_rank_within")).alias(out))


def ranked(df: DataFrame, order: list[Column], out: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with `out`: 1, 2, 3 ... in the stated order over the whole table; ties as in `running_sum`."""
    return running_sum(df, order, F.lit(1), out, ranges).withColumn(out, F.col(out) + 1)
