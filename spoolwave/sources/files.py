"""Shared scratch folders and file systems for sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share. Only a local session may go without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_spoolwave_files", None) or "file://" + tempfile.mkdtemp(prefix="spoolwave-files-")
        spark._spoolwave_files = base
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def listing(uri: str, suffix: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """Files of a folder (or the one file) with the suffix, whatever its case, in name order; resource forks are skipped."""
    fs, path = file_system(uri)
    info = fs.get_file_info(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return fs, sorted((i for i in found if i.type == pafs.FileType.File and i.path.lower().endswith(suffix) and not i.base_name.startswith("._")), key=lambda i: i.path)


def checkpoint(df: DataFrame) -> DataFrame:
    """df written once to the folder that driver and executors share, so that neither a lost executor nor a second use computes it anew."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    return df.checkpoint(eager=True)
