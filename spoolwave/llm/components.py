"""Connected components of an edge table: forests per task, then alternating large-star and small-star rounds, all on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolwave.llm.common import checkpoint

MAX_ROUNDS = 60
#: Edges that one task connects by itself. A larger table is first thinned to a forest for each block of this size.
BLOCK = 1 << 20
#: Edges of one node behind which it counts as a hub in the star rounds: its edges are then dealt over several tasks.
HUB = 1 << 16
MOST_HUBS = 1 << 17


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the pairs connect: at most one per node, however many pairs there are."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        # a root that has met a smaller label takes its whole tree along
        np.minimum.at(label, old[u], low)
        np.minimum.at(label, old[v], low)
        label = label[label]
        if np.array_equal(old, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a bigint, b bigint), any direction, repeats and loops allowed -> (node, component), component the least node.

    Only nodes that have an edge to another node appear. Tables of up to BLOCK edges are one task's work. Larger ones are dealt
    into blocks of about that size, of which each keeps a forest (so a node has at most one edge a block, however many it came
    with); star rounds then go on until the edge table stops changing. A round is two aggregations by node, combined before the
    shuffle, and two joins of the edge table with one row per node, dealt over several tasks for hubs. Lineage is cut in
    every round.
    """
    cur = checkpoint(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    size = cur.count()
    if size <= BLOCK:
        cur = cur.coalesce(1).mapInArrow(_thin, "hi bigint, lo bigint")
        return _labels(checkpoint(cur))
    cur = checkpoint(cur.repartition(-(-size // BLOCK), F.xxhash64("hi", "lo")).mapInArrow(_thin, "hi bigint, lo bigint").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        cur = checkpoint(_small_star(_large_star(cur)))
        now = _signature(cur)
        if now == before:
            return _labels(cur)
        before = now
    raise RuntimeError("components did not settle")


def _labels(star: DataFrame) -> DataFrame:
    low = star.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(low)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's edges; edges are folded in as they come, so memory follows the nodes."""
    hi, lo, held = np.empty(0, np.int64), np.empty(0, np.int64), 0
    more: list[pa.RecordBatch] = []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([hi, *(b.column(0).to_numpy() for b in more)]), np.concatenate([lo, *(b.column(1).to_numpy() for b in more)]))

    for batch in batches:
        more.append(batch)
        held += batch.num_rows
        if held > BLOCK:
            hi, lo = fold()
            more, held = [], 0
    if more:
        hi, lo = fold()
    yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """rows joined with least(key, m, n) by key; a key of n rows is dealt over 1 + n / HUB tasks.

    Both sides know a key's share count: the small side from its count, the rows because hubs are few (at most rows / HUB) and
    are looked up first by a join that needs no shuffle of a hub into one task.
    """
    hubs = least.where(F.col("n") > HUB).select(F.col(key).alias("_hub"), F.floor(F.col("n") / HUB).cast("int").alias("_shares"))
    if not 0 < hubs.count() <= MOST_HUBS:  # beyond a broadcast, skewed keys are left to adaptive execution
        return rows.join(least.drop("n"), key)
    share = least.withColumn("_share", F.explode(F.expr(f"sequence(0, cast(floor(n / {HUB}) as int))"))).drop("n")
    dealt = rows.join(F.broadcast(hubs), rows[key] == F.col("_hub"), "left").withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_shares", F.lit(0)) + 1).cast("int"))
    return dealt.select(*rows.columns, "_share").join(share, [key, "_share"]).drop("_share")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    # for a node below its neighbours m is the node itself, so its edges stay as they are
    return _with_least(both.where("v > u"), least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    linked = _with_least(e, least, "hi")
    return (
        linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .where("hi <> lo")
        .unionByName(least.select("hi", F.col("m").alias("lo")))
        .distinct()
    )
