"""python -m spoolwave formats | containers PATH | inspect PATH | validate PATH | convert PATH STORE | verify STORE."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolwave.operators import catalog
from spoolwave.plans import metadata
from spoolwave.plans.job import LEVELS
from spoolwave.sources.files import file_system


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spoolwave")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("formats", help="list the readers")
    one = sub.add_parser("inspect", help="channels, samples and first values of a recording folder")
    one.add_argument("path")
    four = sub.add_parser("containers", help="blocks, runs or recordings below a folder")
    four.add_argument("path")
    two = sub.add_parser("convert", help="write a recording folder to a store and verify it")
    two.add_argument("path")
    two.add_argument("store")
    two.add_argument("--overwrite", action="store_true")
    two.add_argument("--verify", choices=LEVELS, default="full", help="compare every block, some blocks of every recording, or none")
    two.add_argument("--meta", help="a metadata file whose streams say what is written and how")
    three = sub.add_parser("verify", help="structural checks of a store, and its blocks against the digests saved beside it")
    three.add_argument("store")
    five = sub.add_parser("validate", help="findings about a folder and its metadata file; nothing is written")
    five.add_argument("path")
    five.add_argument("--meta")
    args = parser.parse_args(argv)
    if args.command == "formats":
        from spoolwave.sources.registry import builtin

        from spoolwave.sources.folders import FOLDERS

        print("\n".join([r.name for r in builtin().readers] + [f.name for f in FOLDERS]))
        return 0
    spark = SparkSession.builder.appName("spoolwave").getOrCreate()
    from spoolwave.plans import job
    from spoolwave.sources.folders import conforms, containers, open_folder

    if args.command == "verify":
        found = job.structural_checks(spark.read.parquet(args.store))
        if exists(f"{args.store.rstrip('/')}.digests"):
            states = job.recheck(spark, args.store, spark.read.parquet(f"{args.store.rstrip('/')}.digests"))
            said = F.concat(F.lit("block "), F.col("state"))
            found = found.unionByName(catalog.as_issues(states.where("state <> 'ok'"), "error", said, "recording", F.concat_ws(":", "recording", F.col("channel").cast("string"), F.col("first").cast("string"))))
        return show(found)
    if args.command == "containers":
        print("\n".join(containers(as_uri(args.path))))
        return 0
    session = open_folder(spark, as_uri(args.path))
    if args.command == "inspect":
        print("\n".join(json.dumps(r.asDict()) for r in job.inspect(session.chunks()).orderBy("recording").collect()))
        return 0
    spec = metadata.spec(spark, metadata.read(as_uri(args.meta))) if args.meta else None
    work = job.Job.of(spark, session, spec)
    if args.command == "validate":
        issues = work.plan()[1]
        for fault in conforms(session):
            issues = issues.unionByName(spark.createDataFrame([("error", fault, "session", session.format)], issues.schema))
        return show(issues)
    report = work.write(args.store, args.overwrite, args.verify)
    print(report.json())
    return int(not report.ok)


def show(found: DataFrame, most: int = 100) -> int:
    """Print the number of findings and the first of them; 1 if an error is among them."""
    by_level = {r.level: r.n for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()}
    first = [r.asDict() for r in found.orderBy("level", "target_name", "message").limit(most).collect()]
    print(json.dumps({"findings": sum(by_level.values()), "by_level": by_level, "first": first}, indent=2))
    return int(by_level.get("error", 0) > 0)


def exists(path: str) -> bool:
    import pyarrow.fs as pafs

    fs, where = file_system(as_uri(path))
    return fs.get_file_info(where).type != pafs.FileType.NotFound


def as_uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


if __name__ == "__main__":
    sys.exit(main())
