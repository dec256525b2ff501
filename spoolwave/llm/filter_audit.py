"""How filters interact in every order: histograms of failure masks times integer matrices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolwave.llm.common import SPACE_CLASS, checkpoint, plain, split_small, text_col

LETTERS = "ABCDE"
#: The five filters of the query as failure conditions on a whole text; the fifth (E) is identity with an earlier text.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure by A to D of a text, as 0 or 1. Words are maximal runs without white space."""
    words = F.array_remove(F.split(text, rf"[{SPACE_CLASS}]+"), "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


class Outcomes:
    """Integer matrices over failure masks (rows) and places (columns): place j is step j % k of order j // k.

    A histogram of masks times one of them gives, for every order and step at once, how many documents are kept after the step,
    removed by it, fail it although they were removed before, or fail it alone. `shares` sums a filter's removals over all orders.
    """

    def __init__(self, letters: str = LETTERS) -> None:
        k = len(letters)
        self.orders = ["".join(o) for o in permutations(letters)]
        bit = {c: 1 << i for i, c in enumerate(letters)}
        own = np.array([[bit[c] for c in o] for o in self.orders], np.int64)
        before = (np.cumsum(own, axis=1) - own).ravel()
        own = own.ravel()
        mask = np.arange(1 << k, dtype=np.int64)[:, None]
        fails, gone = (mask & own) != 0, (mask & before) != 0
        self.kept = (~fails & ~gone).astype(np.int64)
        self.removed = (fails & ~gone).astype(np.int64)
        self.redundant = (fails & gone).astype(np.int64)
        self.unique = (mask == own).astype(np.int64)
        self.shares = (own[:, None] == own[None, :]).astype(np.int64)
        self.step = np.tile(np.arange(1, k + 1, dtype=np.int32), len(self.orders))
        self.order = np.repeat(self.orders, k)


RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def outcomes(histograms: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Outcomes of every order and step from histograms(part, docs, good, toxic), each an array of counts by mask.

    A batch of parts is stacked as rows and multiplied at once; parts stay distributed, and what a task holds is a batch of them.
    """
    size = 1 << len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Outcomes(letters)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                stack = {c: rows.column(c).flatten().to_numpy().reshape(-1, size) for c in ("docs", "good", "toxic")}
                removed = stack["docs"] @ m.removed
                columns = [stack["docs"] @ m.kept, removed, stack["docs"] @ m.redundant, stack["docs"] @ m.unique, stack["good"] @ m.removed, stack["toxic"] @ m.removed, removed @ m.shares]
                n, places = rows.num_rows, len(m.step)
                part = rows.column("part").take(pa.array(np.repeat(np.arange(n), places)))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(np.tile(m.order, n), pa.string()), pa.array(np.tile(m.step, n)), *[pa.array(c.ravel()) for c in columns]],
                    names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    return histograms.mapInArrow(run, RESULT)


def failure_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): rows of docs by part, failure mask and labels, summed as far as the last shuffle sums them.

    E holds for a row whose text also stands under a smaller doc_id. Rows fold into counts by (text digest, id, part, mask) before
    anything is joined, so equal rows move once; what then meets the least id of a text meets it on (digest, id), which parts a
    large group of copies by their ids. A row without an id comes after all that have one. Texts are read once: the folded table,
    a digest and a few numbers a row, is checkpointed. A document has a label if any row of its id has it.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_col().alias("_text"))
    mask = sum((F.when(c, 1 << LETTERS.index(k)).otherwise(0) for k, c in text_conditions(F.col("_text")).items()), F.lit(0))
    folded = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest")).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    folded = checkpoint(folded)
    least = folded.groupBy("digest").agg(F.min("doc_id").alias("_least"))
    first = folded.join(least.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_least")), "left")
    told = first.select("doc_id", "part", "n", (F.col("mask") + F.when(F.col("_digest").isNull(), 1 << LETTERS.index("E")).otherwise(0)).alias("mask"), F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)).alias("_deal"))
    # sums by id first; rows without an id are dealt by their texts, as they meet no label anyway
    told = told.groupBy("doc_id", "_deal", "part", "mask").agg(F.sum("n").alias("n"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.lit(0).cast("bigint").alias("_same")).agg(flag("quality"), flag("toxic"))
    told = told.join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("_deal") == F.col("_same")), "left")
    return told.select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang; null is the empty string), order of the five filters (all 120) and step (1 to 5), zeros included:
    documents kept after the step, removed by it, failing it though removed earlier, failing it alone, removed by it with label
    quality = 1 and with toxic = 1, and the removals of its filter summed over all orders.

    Null text is empty: it fails A, and E behind another empty text. Repeated rows of one id count as rows, none is smaller than the
    other. Labels may be missing, null or repeated. Without documents there is no part and no row.
    """
    docs = split_small(plain(docs, "doc_id", "text", "lang").select("doc_id", "text", "lang"))
    labels = plain(labels, "doc_id", "quality", "toxic").select("doc_id", "quality", "toxic")
    counts = failure_rows(docs, labels).groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    # a part has at most 32 masks: the map of a part is bounded
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("docs", "good", "toxic")))).alias("_m"))
    every = F.sequence(F.lit(0), F.lit((1 << len(LETTERS)) - 1))
    cell = lambda c: F.transform(every, lambda i: F.coalesce(F.try_element_at("_m", i)[c], F.lit(0).cast("bigint"))).alias(c)
    return outcomes(by_mask.select("part", cell("docs"), cell("good"), cell("toxic")))


ORACLE_SQL = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
e as (select text, min(doc_id) as least from w group by text),
d as (
  select w.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
    (len(words) < 100) as a, (100 * len(list_distinct(words)) < 80 * len(words)) as b,
    (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text)) as c, regexp_matches(w.text, '[#$%&*|]') as d,
    (e.least is not null and w.doc_id is distinct from e.least) as e
  from w join e on e.text = w.text left join l on l.doc_id = w.doc_id),
m as (select part, [a, b, c, d, e] as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from d group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 3, 4, 5]) as i),
orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order, [p.i, q.i, r.i, s.i, t.i] as o
  from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
steps as (select filter_order, o, step from orders, range(1, 6) r(step)),
f as (
  select part, filter_order, step::int as step, o[step] as own, n, good, toxic, fails[o[step]] as failing,
    list_bool_or(list_transform(range(1, step), lambda j: fails[o[j]])) as gone,
    len(list_filter(fails, lambda x: x)) = 1 as alone
  from m, steps),
g as (
  select part, filter_order, step, own,
    sum(case when not failing and not coalesce(gone, false) then n else 0 end)::bigint as kept,
    sum(case when failing and not coalesce(gone, false) then n else 0 end)::bigint as removed,
    sum(case when failing and coalesce(gone, false) then n else 0 end)::bigint as redundant,
    sum(case when failing and alone then n else 0 end)::bigint as unique_fails,
    sum(case when failing and not coalesce(gone, false) then good else 0 end)::bigint as good_lost,
    sum(case when failing and not coalesce(gone, false) then toxic else 0 end)::bigint as toxic_lost
  from f group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley
from g
"""
