"""The Parquet store: chunked write with a commit marker, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from spoolwave.sources.files import scratch

#: Rows of a file at most.
FILE_ROWS = 4_000_000


def write_store(rows: DataFrame, name: str, chunk: Column | None = None, path: str | None = None, overwrite: bool = False) -> str:
    """Write rows as Parquet and return the path; an existing store is an error unless overwrite.

    Rows are laid out by range of the chunk, so that a range of chunks is in few files whose row groups have tight statistics;
    the output committer's _SUCCESS marks a complete store.
    """
    path = path or scratch(rows.sparkSession, f"store-{name}")
    if chunk is not None:
        rows = rows.withColumn("chunk", chunk).repartitionByRange("chunk").sortWithinPartitions("chunk")
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
