"""Session plans: metadata overlay, defaults and validation as DataFrame programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolwave.operators import catalog


def subject_sex(stated: Column, recorded: Column) -> Column:
    """Stated, else recorded, else U (P25)."""
    return F.coalesce(stated, recorded, F.lit("U"))


def validate(rows: DataFrame, known: DataFrame, ref: str, ref_key: str, unique: list[str], most: int = 1) -> DataFrame:
    """Findings about broken references and keys that repeat more than `most` times."""
    missing = catalog.unknown(rows, known, ref, ref_key)
    repeated = catalog.repeated(rows, unique).where(F.col("n") > most)
    return catalog.as_issues(missing, "error", F.lit("unknown part"), "lineitem", F.col(ref)).unionByName(
        catalog.as_issues(repeated, "warning", F.lit("repeated line"), "lineitem", F.concat_ws(":", *[F.col(c).cast("string") for c in unique]))
    )


def resolve(recordings: DataFrame, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, issues) of a session (V02): specs over defaults, included streams, unique output names, unknown spec keys.

    recordings(name, ...) and spec(key, include, type, out_name). The plan has a row per included stream with its target type and
    output name; issues name repeated outputs and keys of streams that the session does not have.
    """
    named = catalog.with_spec(recordings.withColumnRenamed("name", "key"), spec, "key", ["include", "type"], ["out_name"])
    plan = named.where(F.coalesce("include", F.lit(True))).withColumn("out_name", F.coalesce("out_name", "key"))
    twice = catalog.repeated(plan.select("out_name"), ["out_name"])
    stray = catalog.unknown(spec.where("key <> '*'"), recordings, "key", "name")
    issues = catalog.as_issues(twice, "error", F.lit("output name is used more than once"), "stream", F.col("out_name")).unionByName(
        catalog.as_issues(stray, "warning", F.lit("no such stream"), "stream", F.col("key"))
    )
    return plan.withColumnRenamed("key", "name"), issues
