"""Reading of tables and time columns, and prefix sums that need no single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone, in UTC sessions."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def with_prefix_sum(df: DataFrame, order: str, value: Column, out: str, span: int = 65536) -> DataFrame:
    """Add the sum of `value` over all rows of smaller `order` (a unique bigint), without a window over the whole table.

    Rows are dealt by stretches of `span` order values; stretch totals (one row each) are summed up in a small window and
    joined back, so no task sees more than one stretch of rows.
    """
    cut = df.withColumn("_value", value.cast("bigint")).withColumn("_stretch", F.floor(F.col(order) / span))
    totals = cut.groupBy("_stretch").agg(F.sum("_value").alias("_total"))
    ahead = totals.select("_stretch", F.coalesce(F.sum("_total").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return own.join(ahead, "_stretch").withColumn(out, F.col("_ahead") + F.col("_within")).drop("_value", "_stretch", "_within", "_ahead")
