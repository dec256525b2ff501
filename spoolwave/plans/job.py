"""A job: open a recording, plan, write a store, verify it against its source, report."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spoolwave.operators import catalog, integrity
from spoolwave.plans import overlay
from spoolwave.sources import stretches
from spoolwave.sources.files import file_system

#: Samples of a chunk in the store, which is also the block of its digests.
CHUNK = 65536
#: How much of a store is compared with its source after writing.
LEVELS = ("full", "sampled", "off")


class Cancelled(Exception):
    """The job was cancelled; nothing of it is left."""


@dataclass
class Report:
    """What a job did; findings are counted by level, mismatches are counted and the first of them are kept for display.

    All of them are in the table beside the store.
    """

    store: str
    seconds: float = 0.0
    recordings: dict[str, int] = field(default_factory=dict)
    issues: list[dict] = field(default_factory=list)
    mismatches: list[dict] = field(default_factory=list)
    n_mismatches: int = 0
    tables: dict[str, int] = field(default_factory=dict)
    level: str = "full"
    blocks: int = 0

    @property
    def ok(self) -> bool:
        return not self.n_mismatches and not self.mismatches and not any(i["level"] == "error" for i in self.issues)

    def json(self) -> str:
        return json.dumps({"store": self.store, "ok": self.ok, "seconds": round(self.seconds, 3), "recordings": self.recordings, "tables": self.tables, "level": self.level, "blocks": self.blocks, "issues": self.issues, "n_mismatches": self.n_mismatches, "mismatches": self.mismatches}, indent=2)


@dataclass
class Job:
    """Stretches or chunks (what to read) and a spec (what to write and how). Stop it from another thread with cancel().

    Events, snippets and further tables of a session are written beside the samples, a folder each (K09-K14). All is written to
    a staging folder and moved to its names when it is complete and verified: a job that fails or is cancelled leaves nothing, and
    a store that stood there before stays.
    """

    spark: SparkSession
    source: DataFrame
    spec: DataFrame | None = None
    group: str = "spoolwave-job"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    cancelled: bool = False

    @classmethod
    def of(cls, spark: SparkSession, session, spec: DataFrame | None = None) -> Job:
        """The job of a folder's session, its events and waveforms included."""
        tables = {}
        if session.events is not None:
            tables["events"] = session.events
        if session.snippets is not None:
            tables["snippets"] = session.waveforms()
            tables["units"] = units_table(tables["snippets"])
        if session.metadata:
            tables["metadata"] = spark.createDataFrame(sorted(session.metadata.items()), "key string, value string")
        source = session.signals if session.chunked is None else session.chunks()
        return cls(spark, source, spec, tables=tables)

    def plan(self) -> tuple[DataFrame, DataFrame]:
        """(plan, issues) over the recordings of the source."""
        names = self.source.select(F.col("recording").alias("name")).distinct()
        spec = self.spec if self.spec is not None else self.spark.createDataFrame([], "key string, include boolean, type string, out_name string")
        return overlay.resolve(names, spec)

    def samples(self, plan: DataFrame) -> DataFrame:
        """Chunks of the planned recordings under their output names; those left out are never read."""
        keep = plan.select(F.col("name").alias("recording"), "out_name")
        own = self.source.join(keep, "recording").withColumn("recording", F.col("out_name")).drop("out_name").select(*self.source.columns)
        return stretches.read(own) if "places" in own.columns else own

    def write(self, path: str, overwrite: bool = False, verify: str = "full") -> Report:
        """Plan, write, verify and report. Errors in the plan stop the job before a byte is read.

        Rows and samples are counted while they are written, by observations; nothing is read again to count it. verify is full
        (every block), sampled (some blocks of every recording) or off.
        """
        if verify not in LEVELS:
            raise ValueError(f"verification is one of {', '.join(LEVELS)}")
        began, report = time.time(), Report(path, level=verify)
        sc = self.spark.sparkContext
        sc.setJobGroup(self.group, "write a recording", interruptOnCancel=True)
        self.spark.addTag(self.group)
        fs, base = file_system(path)
        base, scheme = base.rstrip("/"), path.split("://")[0] + "://" if "://" in path else ""
        staging = f"{base}.writing-{uuid.uuid4().hex}"
        try:
            plan, issues = self.plan()
            report.issues = [r.asDict() for r in issues.collect()]
            if any(i["level"] == "error" for i in report.issues):
                return report
            names = [base, *[f"{base}.{t}" for t in (*self.tables, "mismatches", "digests")]]
            if not overwrite and any(fs.get_file_info(n).type != pafs.FileType.NotFound for n in names[: 1 + len(self.tables)]):
                raise FileExistsError(path)
            at = f"{scheme}{staging}/store"
            chunks = self.samples(plan)
            seen = Observation(f"samples-{uuid.uuid4().hex}")
            size = F.size("values").cast("bigint")
            recordings = [r.out_name for r in plan.select("out_name").distinct().collect()]  # a row per recording
            counted = chunks.observe(seen, F.count("*").alias("chunks"), *[F.coalesce(F.sum(F.when(F.col("recording") == n, size)), F.lit(0)).alias(f"of {n}") for n in recordings])
            counted.write.partitionBy("recording").parquet(at)
            found = seen.get
            report.recordings = {n: found[f"of {n}"] for n in sorted(recordings) if found[f"of {n}"]}
            if verify != "off" and report.recordings:
                report.blocks, report.n_mismatches, report.mismatches = self._verify(at, chunks, verify)
            for name, rows in self.tables.items():
                seen = Observation(f"{name}-{uuid.uuid4().hex}")
                rows.observe(seen, F.count("*").alias("n")).write.parquet(f"{at}.{name}")
                report.tables[name] = seen.get["n"]
            if self.cancelled:
                raise Cancelled(path)
            for name in names:  # what the job before it left goes with its store
                new = fs.get_file_info(f"{staging}/store{name[len(base):]}").type != pafs.FileType.NotFound
                if overwrite and fs.get_file_info(name).type != pafs.FileType.NotFound:
                    fs.delete_dir(name)
                if new:
                    fs.move(f"{staging}/store{name[len(base):]}", name)
        except Exception as why:
            if self.cancelled:
                raise Cancelled(path) from why
            raise
        finally:
            self.spark.removeTag(self.group)
            if fs.get_file_info(staging).type != pafs.FileType.NotFound:
                fs.delete_dir(staging)
        report.seconds = time.time() - began
        with fs.open_output_stream(f"{base}.report.json") as f:
            f.write(report.json().encode())
        return report

    def verify(self, path: str, chunks: DataFrame, level: str = "full") -> tuple[dict[str, int], int, list[dict]]:
        """(samples by recording, mismatches, the first 100 of them) of a store against its source."""
        stored = self.spark.read.parquet(path)
        counts = stored.groupBy("recording").agg(F.sum(F.size("values").cast("bigint")).alias("n"))
        return ({r.recording: r.n for r in counts.collect()}, *self._verify(path, chunks, level)[1:])

    def _verify(self, path: str, chunks: DataFrame, level: str) -> tuple[int, int, list[dict]]:
        """(blocks compared, mismatches, the first 100): digests of the source's blocks against those of the store's.

        The sampled level chooses blocks of every recording from their places alone, and reads no other block's values of either
        side. All bad blocks are written to the table PATH.mismatches, the digests of a full verification to PATH.digests.
        """
        stored = self.spark.read.parquet(path)
        if level == "sampled":
            chosen = sampled_blocks(stored)
            chunks, stored = chosen_chunks(chunks, chosen), chosen_chunks(stored, chosen)
        a, b = digests(chunks), digests(stored)
        where = path.rstrip("/")
        if level == "full":
            a.write.mode("overwrite").parquet(f"{where}.digests")
            a = self.spark.read.schema(a.schema).parquet(f"{where}.digests")
        seen = Observation(f"blocks-{uuid.uuid4().hex}")
        found = integrity.compare(a, b, ["recording", "channel", "first"]).observe(seen, F.count("*").alias("n")).where("state <> 'ok'")
        found.write.mode("overwrite").parquet(f"{where}.mismatches")
        bad = self.spark.read.schema(found.schema).parquet(f"{where}.mismatches")
        shown = bad.orderBy("recording", "channel", "first").limit(100)
        return seen.get["n"], bad.count(), [r.asDict() for r in shown.collect()]

    def cancel(self) -> None:
        """Stop the job's tasks; write() removes what was written and raises Cancelled."""
        self.cancelled = True
        self.spark.interruptTag(self.group)

    def running(self) -> bool:
        """Whether tasks of the job are at work."""
        status = self.spark.sparkContext.statusTracker()
        jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup(self.group)]
        stages = [status.getStageInfo(k) for j in jobs if j for k in j.stageIds]
        return any(k and k.numActiveTasks for k in stages)

    def progress(self) -> tuple[int, int]:
        """(done, all) tasks of the job's active stages."""
        status = self.spark.sparkContext.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(self.group) for s in (status.getJobInfo(j).stageIds if status.getJobInfo(j) else [])]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)


def units_table(snippets: DataFrame) -> DataFrame:
    """(store, channel, sort_code, spikes, first, last, mean): a row per unit, the mean waveform taken point by point."""
    own = snippets.where("sort_code <> 0")
    sums = own.groupBy("store", "channel", "sort_code").agg(F.count("*").alias("spikes"), F.min("t").alias("first"), F.max("t").alias("last"))
    points = own.select("store", "channel", "sort_code", F.posexplode("waveform").alias("_i", "_v")).groupBy("store", "channel", "sort_code", "_i").agg(F.avg("_v").alias("_v"))
    mean = points.groupBy("store", "channel", "sort_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("mean"))
    return sums.join(mean, ["store", "channel", "sort_code"])


def digests(chunks: DataFrame) -> DataFrame:
    """(recording, channel, first, digest) of every chunk: its values' text is stable across write and read."""
    said = F.concat_ws(",", F.transform("values", lambda v: v.cast("string")))
    return chunks.select("recording", "channel", "first", F.sha2(said, 256).alias("digest"))


def sampled_blocks(store: DataFrame, some: int = 8, seed: int = 0) -> DataFrame:
    """(recording, channel, first) of the first, the last and `some` further chunks of every channel; values are not read."""
    return integrity.choose_blocks(store.select("recording", "channel", "first"), ["recording", "channel"], "first", some, seed)


def chosen_chunks(chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chunks at the chosen places; the choice is a few rows a channel and is broadcast where Spark finds it small."""
    return chunks.join(chosen, ["recording", "channel", "first"], "left_semi")


def recheck(spark: SparkSession, path: str, saved: DataFrame) -> DataFrame:
    """States of a store's blocks against saved digests, without the source."""
    return integrity.compare(saved, digests(spark.read.parquet(path)), ["recording", "channel", "first"])


def structural_checks(store: DataFrame) -> DataFrame:
    """Findings about a store: null cells, chunks that overlap or leave gaps, repeated chunks."""
    from pyspark.sql import Window

    nulls = store.where("recording is null or channel is null or first is null or `values` is null").select(F.coalesce("recording", F.lit("?")).alias("recording"))
    w = Window.partitionBy("recording", "channel").orderBy("first")
    step = store.select("recording", "channel", "first", (F.lag(F.col("first") + F.size("values")).over(w)).alias("_due")).where("_due is not null and _due <> first")
    return catalog.as_issues(nulls, "error", F.lit("a chunk has a null cell"), "recording", F.col("recording")).unionByName(
        catalog.as_issues(step, "error", F.when(F.col("_due") > F.col("first"), "chunks overlap").otherwise("samples are missing"), "recording", F.concat_ws(":", "recording", F.col("channel").cast("string"), F.col("first").cast("string")))
    )


def inspect(chunks: DataFrame, at: int = 0, shown: int = 5) -> DataFrame:
    """(recording, channels, samples, head): the first samples of channel 0 from a position, as JSON-ready rows."""
    size = chunks.groupBy("recording").agg(F.count_distinct("channel").alias("channels"), F.max(F.col("first") + F.size("values")).alias("samples"))
    near = stretches.samples(chunks.where((F.col("channel") == 0) & (F.col("first") + F.size("values") > at) & (F.col("first") < at + shown))).where((F.col("sample") >= at) & (F.col("sample") < at + shown))
    head = near.groupBy("recording").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda s: s["value"]).alias("head"))
    return size.join(head, "recording", "left")
