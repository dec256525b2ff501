"""Helpers shared by the training-data operators: input reading, shared scratch folders, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that count as white space in every word rule of the operators: space and 0x09-0x0D.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Bytes of a file that Spark reads in one piece.
SPLIT_BYTES = 128 << 20
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain(df: DataFrame, *needed: str) -> DataFrame:
    """df with every column but the needed ones under a neutral name, so that no extra column (whatever its name or case, even
    a second one of the same name) clashes with what an operator adds. Columns keep their order."""
    names, left = [], set(needed)
    for i, n in enumerate(df.columns):
        names.append(n if n in left else f"extra_{i}")
        left.discard(n)
    return df.toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, whose executors are the driver, may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_spoolwave_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="spoolwave-")
            spark._spoolwave_scratch = base
    return base.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; batches are bounded by spark.sql.execution.arrow.maxRecordsPerBatch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small input comes in fewer partitions than there are cores; any other input stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_small(df: DataFrame) -> DataFrame:
    """df over all cores where it is read from fewer files than there are cores, none large enough to be split; else as it lies."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < files < cores and size <= files * SPLIT_BYTES else df


def text_col(name: str = "text"):
    """Text with null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))
