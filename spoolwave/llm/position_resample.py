"""Importance resampling towards a target distribution, on a position table of n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.llm.common import plain, split_small, text_col
from spoolwave.operators.ranking import ranked

#: What separates words, after A-Z are lower-cased: ASCII that is neither digit nor small letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
#: Positions of a text that one window sees; a block also holds the few words after it that its last n-grams need.
BLOCK = 8192


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def position_table(rows: DataFrame, keys: list[str], order: int, block: int = BLOCK) -> DataFrame:
    """(keys, feature, order) of rows(keys, text): every run of 1 to `order` neighbouring words, one row per place it starts at.

    Words get their positions by posexplode. Runs of several words are the word and what lead() finds 1, 2 ... positions on, in
    a window per text and block of positions, so that a long text is many windows. keys must tell rows apart where order > 1.
    A text without words gives one row without a feature, which keeps it in the table.
    """
    words = rows.select(*keys, words_of(F.col("text")).alias("_words"))
    if order == 1:
        return words.select(*keys, F.posexplode_outer("_words").alias("_pos", "feature"), F.lit(1).alias("order")).drop("_pos")
    blocks = F.expr(f"transform(sequence(0, greatest(0, cast((size(_words) - 1) div {block} as int))), b -> slice(_words, b * {block} + 1, {block + order - 1}))")
    places = words.select(*keys, F.posexplode(blocks).alias("_block", "_own")).select(*keys, "_block", F.posexplode_outer("_own").alias("_pos", "_word"))
    along = Window.partitionBy(*keys, "_block").orderBy("_pos")
    following = [F.lead("_word", k).over(along).alias(f"_w{k}") for k in range(1, order)]
    wide = places.select(*keys, "_pos", "_word", *following).where(F.col("_pos").isNull() | (F.col("_pos") < block))
    runs = []
    for n in range(1, order + 1):
        parts = [F.col("_word"), *[F.col(f"_w{k}") for k in range(1, n)]]
        whole = parts[-1].isNotNull() if n > 1 else F.lit(True)
        runs.append(F.when(whole, F.struct(F.concat_ws(" ", *parts).alias("feature") if n > 1 else F.col("_word").alias("feature"), F.lit(n).alias("order"))))
    return wide.select(*keys, F.explode(F.filter(F.array(*runs), lambda r: r.isNotNull())).alias("_run")).select(*keys, "_run.feature", "_run.order")


def _bucket(buckets: int) -> Column:
    return F.when(F.col("feature").isNotNull(), F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)))


def bucket_counts(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all rows by bucket; counts are combined before the shuffle."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id()) if order > 1 else rows
    table = position_table(rows, ["_row"] if order > 1 else [], order)
    return table.select(_bucket(buckets).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), s and S counted over all documents, t and T
    over all target texts, B buckets. The table has B rows whatever the corpus."""
    s, t = bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets)
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("s_all") + buckets) / ((d("s") + 1) * (d("t_all") + buckets))
    return both.join(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000) * F.ln(ratio)).cast("bigint").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, order: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row of docs: the floored mean gain of its features, 0 without any.

    Gains are broadcast: as many rows as there are buckets, a parameter. Sums of a document are combined before the shuffle, so a
    long text moves a row or a few, not its words.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    table = position_table(rows, ["_row", "doc_id"], order).withColumn("bucket", _bucket(buckets))
    summed = table.join(F.broadcast(gain), "bucket", "left").groupBy("_row", "doc_id").agg(F.count("feature").alias("n_features"), F.count(F.when(F.col("order") == 1, F.col("feature"))).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    mean = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("bigint")
    return summed.select("doc_id", "n_words", "n_features", mean.alias("weight"))


def gumbel(id_col: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256(seed:id): adding it to log weights and taking the largest draws
    without replacement. A row without an id has the text `null` in its place."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per input row; rank is 1, 2, 3 ... for the rows drawn, else null.

    Features are runs of 1 to `order` words. Of the N rows with at least least_words words, floor(percent N / 100) highest scores are
    drawn; ties go to the smaller doc_id, a row without an id comes last. Null text has no words: no features, weight 0. Repeated
    rows are rows of their own: they count in S, score alike and get neighbouring ranks. Empty documents give an empty result; empty
    target texts give gains against the even distribution.
    """
    docs = split_small(plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text")))
    target = plain(target, "text").select(text_col().alias("text"))
    told = weights(docs, gains(docs, target, order, buckets), order, buckets)
    told = told.select("*", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("_open"))
    order_by = [F.col("_open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = ranked(told, order_by, "_rank")
    open_rows = placed.agg(F.count(F.when(F.col("_open"), 1)).alias("_n"))
    drawn = F.col("_open") & (F.col("_rank") <= F.expr(f"_n * {int(percent)} div 100"))
    return placed.join(F.broadcast(open_rows)).select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_rank")).alias("rank"))


#: The same in DuckDB for the stated parameters; crc32 byte by byte through its table (a rule, not a list) over distinct words.
ORACLE_SQL = r"""
with recursive steps as (
  select i, i::bigint as c, 0 as k from range(256) t(i)
  union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
tab as (select list(c order by i) as t from steps where k = 8),
w as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
h as (select word, hex(encode(word)) as x from (select distinct word from (select word from w union all select word from b))),
crc as (
  select word, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::bigint, 2))::bigint)),
    lambda c, v: xor(c >> 8, tab.t[xor(c & 255, v) + 1])), 4294967295::bigint) % 10000)::bigint as bucket from h, tab),
s as (select bucket, count(*) as s from w join crc using (word) group by bucket),
t as (select bucket, count(*) as t from b join crc using (word) group by bucket),
n as (select (select count(*) from w)::double as S_all, (select count(*) from b)::double as T_all),
g as (select s.bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (S_all + 10000) / ((s::double + 1) * (T_all + 10000))))::bigint as gain from s left join t using (bucket), n),
f as (select doc_id, count(*)::bigint as n, sum(gain)::bigint as total from w join crc using (word) join g using (bucket) group by doc_id),
d as (
  select documents.doc_id, coalesce(n, 0)::bigint as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::bigint::double + 0.5) / 4294967296)))::bigint as noise
  from documents left join f using (doc_id)),
r as (select *, weight + noise as score, row_number() over (partition by n_features >= 20 order by weight + noise desc, doc_id) as place from d)
select doc_id, n_features, weight, score::bigint as score,
  case when n_features >= 20 and place <= (select count(*) from d where n_features >= 20) * 10 // 100 then place end::bigint as rank
from r
"""
