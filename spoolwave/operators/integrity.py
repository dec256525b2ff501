"""Block digests, comparison and recheck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_digests(rows: DataFrame, keys: list[str], order: list[str], said: Column) -> DataFrame:
    """(keys, n, digest): SHA-256 over the ordered texts of a block's rows (A19); a block is bounded by its key."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, said.alias("_said"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda s: s["_said"]), "\n"), 256).alias("digest"))


def overall_digest(blocks: DataFrame, keys: list[str], block: str) -> DataFrame:
    """(keys, digest): digest over a path's ordered block digests."""
    ordered = F.array_sort(F.collect_list(F.struct(block, "digest")))
    return blocks.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["digest"]), ""), 256).alias("digest"))


def compare(source: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state): ok, differs, missing or extra for each block of either side."""
    a = source.select(*keys, F.col("digest").alias("_a"))
    b = stored.select(*keys, F.col("digest").alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "ok").otherwise("differs")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def choose_blocks(places: DataFrame, keys: list[str], at: str, some: int = 8, seed: int = 0) -> DataFrame:
    """(keys, at) of the first, the last and `some` further blocks of every array, all where there are few.

    places has a row a block: (keys, at). The inner blocks are ranked by a digest of seed, keys and place; a limit by rank is
    applied before the shuffle, so of each array a few rows a task move, and reruns agree.
    """
    places = places.select(*keys, at).distinct()
    ends = places.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    inner = places.join(ends, keys).where((F.col(at) > F.col("_a")) & (F.col(at) < F.col("_b")))
    said = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in (*keys, at)]))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(said, at))
    drawn = inner.select(*keys, at, rank.alias("_n")).where(F.col("_n") <= some).select(*keys, at)
    return ends.select(*keys, F.explode(F.array_distinct(F.array("_a", "_b"))).alias(at)).unionByName(drawn)


def mismatch_summary(states: DataFrame, path: str, block: str, shown: int = 5) -> DataFrame:
    """(path, blocks, mismatches, first): paths with bad blocks and the first of them."""
    bad = F.col("state") != "ok"
    counts = states.groupBy(path).agg(F.count("*").alias("blocks"), F.count(F.when(bad, 1)).alias("mismatches")).where("mismatches > 0")
    # the first few of each path are cut before they are gathered, however many there are
    few = states.where(bad).withColumn("_n", F.row_number().over(Window.partitionBy(path).orderBy(block))).where(F.col("_n") <= shown)
    return counts.join(few.groupBy(path).agg(F.array_sort(F.collect_list(block)).alias("first")), path)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 0.0) -> Column:
    """|a - b| <= atol + rtol |b|, NaN equal to NaN."""
    return (F.isnan(a) & F.isnan(b)) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False)) & ~F.isnan(a) & ~F.isnan(b)


def physical(data: Column, factors: Column, conversion: float, offset: float) -> Column:
    """data * conversion * channel factor + offset over channel arrays."""
    return F.zip_with(data, factors, lambda v, g: v.cast("double") * conversion * g + offset)


def block_values(rows: Column, block_rows: int, block: Column) -> Column:
    """Rows of one block of an array."""
    return F.least((block + 1) * block_rows, rows) - block * block_rows
