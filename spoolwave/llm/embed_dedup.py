"""Embedding near-duplicates by quantised tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolwave.llm.common import checkpoint, map_batches, plain
from spoolwave.llm.components import connected_components, forest

THRESHOLD = 0.9
#: Vectors per cell that the number of cells aims at, the most cells, and the bound of the sample their centres are fitted on.
CELL_SIZE = 128
MOST_CELLS = 16384
SAMPLE = 20000
ROUNDS = 4
#: Rows on a side of a tile product; a larger cell is dealt into several tiles.
TILE = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component is taken out first, so no square overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes (as float32 for the product, whose sums stay exact), scale and length of the error of each unit vector."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None])
    err = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return code.astype(np.float32 if x.shape[1] <= 1024 else np.float64), scale, err


def linked(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold between the rows of two unit matrices.

    |x.y - sx sy qx.qy| <= |ey| + |ex| (1 + |ey|). Pairs whose upper bound is below the threshold are out and pairs whose
    lower bound is above are in; only those in between are computed in double precision.
    """
    qx, sx, ex = quantise(x)
    qy, sy, ey = quantise(y)
    near = (qx @ qy.T).astype(np.float64) * sx[:, None] * sy[None, :]
    bound = ey[None, :] + ex[:, None] * (1.0 + ey[None, :])
    sure = near - bound >= threshold + 1e-9
    i, j = np.nonzero((near + bound >= threshold - 1e-9) & ~sure)
    hit = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        hit[k : k + (1 << 16)] = (x[i[k : k + (1 << 16)]] * y[j[k : k + (1 << 16)]]).sum(axis=1) >= threshold
    si, sj = np.nonzero(sure)
    return np.concatenate([si, i[hit]]), np.concatenate([sj, j[hit]])


def centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced start rows; an empty cell keeps its centre."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        best = np.concatenate([(sample[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, best, sample)
        size = np.sqrt((total * total).sum(axis=1))
        some = size > 1e-12
        c[some] = total[some] / size[some, None]
    return c.astype(np.float32)


def _valid(batch: pa.RecordBatch, code: str) -> pa.RecordBatch:
    out = []
    for v, i in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
        ok = i is not None and v and None not in v
        a = np.array(v, np.float64) if ok else None
        ok = ok and bool(np.isfinite(a).all()) and bool(a.any())
        out.append((a + 0.0).astype(code).tobytes() if ok else None)
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row per input row.

    Equal vectors are one class from the start, so copies cost nothing further. Classes are assigned to the cells of centres
    fitted on a bounded sample, and cells that lie near each other form groups; each class lives in the group of its nearest
    cell and visits every group with a cell that may hold a partner: by the triangle inequality of angles none is nearer than
    the angle to the centre less the cell's radius. So no link is missed, and data that no bound parts are compared pair by
    pair. Of two groups one hosts their pairs. Groups larger than a tile are dealt into tiles, and a tile returns sums of
    links and a spanning forest, never its pairs. Every link has cosine >= threshold in double precision.

    Vectors that are null, empty, zero, hold a null or a non-finite component, or have no vec_id link with nothing. Vectors of
    different lengths are never linked. Repeated rows are further vectors of their class. Labels and other columns are not
    read. An empty table gives an empty result.
    """
    vectors = plain(vectors, "vec_id", "embedding")
    kind = dict(vectors.dtypes)["embedding"]
    code = "<f4" if kind == "array<float>" else "<f8"
    rows = checkpoint(map_batches(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"), lambda b: _valid(b, code), "vec_id bigint, vec binary"))
    classes = checkpoint(
        rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id())
    )
    found = checkpoint(_compare(classes, code, threshold))
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("_links"))
    parts = connected_components(found.where("kind = 1").select("a", "b"))
    named = (
        classes.select("vec", "cid", "first", "n")
        .join(links, "cid", "left")
        .join(parts.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("vec", (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(named, "vec", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _compare(classes: DataFrame, code: str, threshold: float) -> DataFrame:
    """(kind, a, b): kind 0 adds b links to class a, kind 1 connects classes a and b."""
    n = classes.count()
    k = int(min(MOST_CELLS, max(1, n // CELL_SIZE), max(1, min(n, SAMPLE))))
    picked = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect() if n else []
    widths = [len(r.vec) for r in picked]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 4
    sample = np.frombuffer(b"".join(r.vec for r in picked if len(r.vec) == width), code).reshape(-1, width // np.dtype(code).itemsize)
    middle = centres(unit(sample), min(k, len(sample))) if len(sample) else np.zeros((1, 1), np.float32)
    groups = np.argmax(middle @ centres(middle.astype(np.float64), min(max(1, n // TILE), len(middle))).T, axis=1)
    middle, groups = middle[np.argsort(groups, kind="stable")], np.sort(groups)  # the cells of a group lie in a row
    opens = np.flatnonzero(np.diff(groups, prepend=-1))
    near = np.float64(np.arccos(np.clip(threshold, -1.0, 1.0)))

    def cosines(raw: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, float]]:
        """Rows, their cosines to the centres (the shorter of two is filled up with zeros) and a bound of the cosines' error."""
        for w in {len(v) for v in raw}:
            own = [i for i, v in enumerate(raw) if len(v) == w]
            for at in range(0, len(own), 512):
                part = own[at : at + 512]
                x = unit(np.frombuffer(b"".join(raw[i] for i in part), code).reshape(len(part), -1)).astype(np.float32)
                d = min(x.shape[1], middle.shape[1])
                yield part, x[:, :d] @ middle[:, :d].T, 1e-5 + 2e-7 * d

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1).to_pylist()
        cell, least = np.zeros(len(raw), np.int32), np.zeros(len(raw))
        for part, s, error in cosines(raw):
            cell[part] = s.argmax(axis=1)
            least[part] = s.max(axis=1) - error
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(cell), pa.array(least)], names=["cid", "n", "vec", "cell", "least"])

    settled = map_batches(classes.select("cid", "vec", "n"), settle, "cid bigint, n bigint, vec binary, cell int, least double")
    settled = checkpoint(settled)
    # for vectors of the usual length and for all others: the least cosine that a bound needs to a cell's centre; 2 where nobody lives
    needed = np.full((2, len(middle)), 2.0)
    for r in settled.groupBy("cell", (F.length("vec") == width).alias("usual")).agg(F.min("least").alias("least")).collect():
        needed[int(r.usual), r.cell] = np.cos(min(np.pi, near + np.arccos(np.clip(r.least, -1.0, 1.0))))

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, home = batch.column(2).to_pylist(), groups[batch.column(3).to_numpy()]
        to: list = [None] * len(raw)
        for part, s, error in cosines(raw):
            may = np.logical_or.reduceat(s + error >= needed[int(len(raw[part[0]]) == width)], opens, axis=1)
            for i, row in zip(part, may):
                other = groups[opens[row]]
                # of two groups the upper one hosts if their sum is odd, else the lower one; the own group always does
                to[i] = other[(other == home[i]) | ((other > home[i]) == ((other + home[i]) % 2 == 1))].astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(home.astype(np.int32)), pa.array(to, pa.list_(pa.int32()))], names=["cid", "n", "vec", "home", "to"])

    placed = map_batches(settled.select("cid", "n", "vec", "cell"), visit, "cid bigint, n bigint, vec binary, home int, to array<int>")
    # groups are kept apart by the vectors' length
    placed = checkpoint(placed.withColumn("width", F.length("vec")))
    calls = placed.select("cid", "n", "vec", "home", "width", F.explode("to").alias("cell"))
    homes = placed.groupBy(F.col("home").alias("cell"), "width").agg(F.count("*").alias("homes"))
    tiles = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / TILE)).cast("int")
    sizes = calls.groupBy("cell", "width").agg(F.count("*").alias("visits")).join(homes, ["cell", "width"]).select("cell", "width", tiles("homes").alias("th"), tiles("visits").alias("tv"))
    sizes = checkpoint(sizes)
    own = F.pmod(F.xxhash64("cid"), F.col("th")).cast("int")
    other = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("tv")).cast("int")
    lives = placed.withColumn("cell", F.col("home")).join(sizes, ["cell", "width"]).select("cell", "width", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("tv") - 1)).alias("j"), F.lit(True).alias("lives"), "cid", "n", "vec", "home")
    visits = calls.join(sizes, ["cell", "width"]).select("cell", "width", F.explode(F.sequence(F.lit(0), F.col("th") - 1)).alias("i"), other.alias("j"), F.lit(False).alias("lives"), "cid", "n", "vec", "home")

    def product(t: pa.Table) -> pa.Table:
        here = t.column("cell")[0].as_py()
        lives = t.column("lives").to_numpy(zero_copy_only=False)
        cid, n, home = t.column("cid").to_numpy(), t.column("n").to_numpy(), t.column("home").to_numpy()
        x = unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), code).reshape(len(cid), -1))
        h, v = np.flatnonzero(lives), np.flatnonzero(~lives)
        i, j = linked(x[h], x[v], threshold)
        i, j = h[i], v[j]
        # residents of one group meet twice in order, kept once
        once = (home[j] != here) | (cid[i] < cid[j])
        i, j = i[once], j[once]
        a, b = forest(cid[i], cid[j])
        ends = np.concatenate([cid[i], cid[j]])
        nodes, at = np.unique(ends, return_inverse=True)
        total = np.zeros(len(nodes), np.int64)
        np.add.at(total, at, np.concatenate([n[j], n[i]]))
        kinds = np.concatenate([np.zeros(len(nodes), np.int32), np.ones(len(a), np.int32)])
        return pa.table({"kind": kinds, "a": np.concatenate([nodes, a]).astype(np.int64), "b": np.concatenate([total, b]).astype(np.int64)})

    return lives.unionByName(visits).groupBy("cell", "width", "i", "j").applyInArrow(product, "kind int, a bigint, b bigint")
