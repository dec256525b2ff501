"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.llm.common import SPACE_CLASS, WORD, plain, split_small, text_col
from spoolwave.operators.ranking import running_sum

#: Shares of a source that meet its target apart, so that a large source is no single task of a join.
SHARES = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def sampling_key(id_col: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from a digest of seed and id: smallest keys come first, reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """sizes(source, source_size) -> (source, source_size, target); further columns come along.

    Sources in code-point order, null last, take the weights in turn and share `share` times all sizes. A target stops at
    `most` times its source; the excess goes to the others by weight until none is above. That fixed point is a water level:
    sources ordered by capacity over weight fill up first, so two running sums and one comparison give it without a loop.
    The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    )
    return t.select(*sizes.columns, F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row; small columns of the input named in keep come along.

    taken counts words: whole epochs of the source first, then a fractional pass in which documents are ordered by their
    sampling key and taken while the running sum stays within what is left of the target. The document that crosses the
    target gives only the words that still fit, so a source's taken words equal its target rounded to a word.
    quality(doc_id, quality) sets weights: the mean quality q of a document gives 0.5 + 1.5 q, none gives 1.
    Null text has size 0 and takes 0. Null sources are one source, the last. Ties in the key (repeated ids, rows without an id) are
    ordered by size, id and text; equal rows are interchangeable, and rows of one key are dealt over tasks like any others. Empty
    input gives an empty result.
    """
    docs = split_small(plain(docs, "doc_id", "text", "source", *keep))
    base = docs.select("doc_id", "source", word_count(text_col()).alias("size"), F.xxhash64("text").alias("_tie"), *keep)
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("_q_id")).agg(F.avg("quality").alias("_q"))
        base = base.join(q, base["doc_id"] == q["_q_id"], "left").withColumn("_w", F.coalesce(F.lit(0.5) + 1.5 * F.col("_q"), F.lit(1.0))).drop("_q_id", "_q")
    else:
        base = base.withColumn("_w", F.lit(1.0))
    keyed = base.withColumn("_key", sampling_key(F.col("doc_id"), F.col("_w"))).withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)))
    # words of all rows before, sources one after another; texts are read and counted once, for the rows that this deals and keeps
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("size"), F.col("doc_id"), F.col("_tie")]
    placed = running_sum(keyed, order, F.col("size"), "_run").withColumn("_s", _source_key())
    # one row per source and share
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_run").alias("_start"))
    goals = targets(sums).withColumn("_s", _source_key()).drop("source").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))
    out = placed.join(goals, ["_s", "_share"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("_rest") - (F.col("_run") - F.col("_start"))))
    out = out.withColumn("_epochs", epochs).withColumn("_rest", rest)
    cols = ["doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).alias("taken")]
    return out.select(*cols, *keep)


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The mix as documents: a row for each whole copy taken, and one cut after its words for the document that crosses a target.

    The mix is made on ids, digests and sizes; texts are shuffled once, to meet what is taken of them. Rows that are equal in id,
    text and source share what they take: one of them, the least by a hash of all columns, stands for all. Rows of one text in two
    sources take for their own source each. Equal rows fold into one before the shuffle.
    """
    names, docs = docs.columns, plain(docs, "doc_id", "text", "source", "n_chars")
    keys = ["_id", "_digest", "_s"]
    sorts = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    own = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_digest": F.md5(text_col()), "_s": _source_key(), "_hash": F.xxhash64(*sorts)})
    taken = mix(own.withColumnsRenamed({k: f"own{k}" for k in (*keys, "_hash")}), quality, tuple(f"own{k}" for k in (*keys, "_hash")))
    taken = taken.groupBy(*[F.col(f"own{k}").alias(k) for k in keys]).agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size"), F.min("own_hash").alias("_hash")).where("_taken > 0")
    one = own.dropDuplicates([*keys, "_hash"])
    copies = one.join(taken, [*keys, "_hash"]).withColumn("_cut", F.explode(F.expr("transform(sequence(1, cast(ceil(_taken / _size) as int)), i -> least(_size, _taken - (i - 1) * _size))")))
    # words with the space before them, laid end to end again: a pattern that counts would recurse once per word
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"[{SPACE_CLASS}]*{WORD}"), F.lit(0))
    cut = F.col("_cut") < F.col("_size")
    out = copies.withColumn("text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_cut").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns).toDF(*names)


#: The same mix in DuckDB: direct running sums per source, the water level by its definition over all prefixes.
ORACLE_SQL = r"""
with q as (select doc_id, avg(quality) as q from labels group by doc_id),
base as (
  select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
           / coalesce(0.5 + 1.5 * q.q, 1.0) as k
  from documents d left join q on q.doc_id = d.doc_id),
s as (select source, sum(size)::bigint as source_size from base group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint]::double as w, 2.0 * source_size as cap from s),
l as (select a.source, (select 1.5 * sum(source_size) from s) as budget,
        ((select 1.5 * sum(source_size) from s) - coalesce((select sum(b.cap) from w b where b.cap / b.w < a.cap / a.w), 0))
        / (select sum(b.w) from w b where b.cap / b.w >= a.cap / a.w) as level, a.cap, a.w from w a),
lv as (select min(level) as level from (select level from l where level * w <= cap order by cap / w limit 1)),
t as (select w.source, w.source_size, least(w.cap, lv.level * w.w) as target from w, lv),
r as (select b.doc_id, b.size, t.source_size, t.target,
        coalesce(sum(b.size) over (partition by b.source order by b.k, b.size, b.doc_id rows between unbounded preceding and 1 preceding), 0) as before
      from base b join t on t.source is not distinct from b.source)
select doc_id, size, source_size, target,
  (floor(target / source_size) * size + greatest(0, least(size, round(target - floor(target / source_size) * source_size)::bigint - before)))::bigint as taken
from r
"""
