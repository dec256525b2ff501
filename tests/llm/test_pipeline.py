"""The pipeline against its stages applied by hand, and the whole registered set on the smallest tables."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from spoolwave.llm import line_crf, secret_scan, simhash, source_mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in line_crf.classify(docs, labels).where("predicted = 1").collect()}
    one = docs.where(F.col("doc_id").isin(list(good)))
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == good
    first = {r.id for r in simhash.similar_groups(one).groupBy("group").agg(F.min("id").alias("id")).collect()}
    two = corpus_pipeline.near_duplicates(spark, one, SF)
    assert {r.doc_id for r in two.collect()} == first and two.columns == docs.columns
    two = spark.createDataFrame(two.collect(), docs.schema)
    three = spark.createDataFrame(corpus_pipeline.secrets(spark, two, SF).collect(), docs.schema)
    flagged = {r.doc_id for r in secret_scan.scan(two).where("spans <> ''").collect()}
    before, after = {r.doc_id: r.text for r in two.collect()}, {r.doc_id: r.text for r in three.collect()}
    assert before.keys() == after.keys() and {i for i in before if before[i] != after[i]} == flagged
    assert not any(r.n_assign for r in secret_scan.scan(three).collect() if "[SECRET]" not in after[r.doc_id])
    four = corpus_pipeline.mixing(spark, three, SF)
    taken = {r.doc_id: r.taken for r in source_mix.mix(three, labels.select("doc_id", "quality")).collect()}
    words = {}
    rows = four.collect()
    for r in rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
        assert after[r.doc_id].startswith(r.text)
    assert words == {k: v for k, v in taken.items() if v} and four.columns == docs.columns
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, lib.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in found} and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)


def test_queries_against_sql(spark):
    import math
    import os

    import duckdb

    from spoolwave.llm import queries

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    plain = lambda v: float(f"{v:.12g}") if isinstance(v, float) and not math.isnan(v) else v
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
        cur = con.execute(sql)
        named = [d[0] for d in cur.description]
        assert sorted(named) == cols
        assert got == sorted(repr([plain(r[named.index(c)]) for c in cols]) for r in cur.fetchall()), name
