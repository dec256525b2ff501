"""Queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spoolwave.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.line_crf import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.source_mix import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.wrapper import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.weak_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spoolwave.llm.bpe_trie import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_position_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.position_resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_plane_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spoolwave.llm.plane_store import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoolwave.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_dedup, op2_secret_scan, op3_line_crf, op4_source_mix, op5_wrapper, op6_weak_rules, op7_simhash, op8_warc, op9_bpe, op10_embed_dedup,
        op11_position_resample, op12_plane_store, op13_filter_audit,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from spoolwave.llm import filter_audit, position_resample, secret_scan, source_mix, warc

    return {
        "op2_secret_scan": secret_scan.ORACLE_SQL,
        "op4_source_mix": source_mix.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op11_position_resample": position_resample.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
    }
