"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    alignment, bpe, decontaminate, minhash, oracle, periods, quality, rlz, sharding, simhash,
    suffix_dedup, surrogates, tokens, warc)
from ledgerloom.llm.common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, read(spark, sf_dir, "labels"), keep_text=False)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_pii(docs)


def op4_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.rlz_report(read(spark, sf_dir, "documents"))


def op5_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(read(spark, sf_dir, "pages"))


def op6_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(read(spark, sf_dir, "documents"))


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard_documents(read(spark, sf_dir, "documents"))
            .withColumn("law", F.lit("key")))


def op8_directly_addressable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(read(spark, sf_dir, "documents"),
                               public_tokenizers.path("word_bpe_49k.json"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3,
                                   percent=85).drop("g", "h")


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True,
                             keep_text=False)


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(periods.repeat_tails(read(spark, sf_dir, "documents")))


def op12_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_isolation_forest, op3_surrogates, op4_relative_lempel_ziv,
        op5_sharded_warc, op6_suffix_sort, op7_rendezvous, op8_directly_addressable,
        op9_chosen_path, op10_bpe_transducer, op11_lyndon_runs,
        op12_pigeonring, op13_merge_path)}

ORACLE: dict[str, str] = {
    "op1_decontamination": oracle.DECONTAMINATION,
    "op4_relative_lempel_ziv": oracle.SUBSTRINGS,
    "op5_sharded_warc": oracle.RECORDS,
    "op6_suffix_sort": oracle.BYTE_STRINGS,
    "op9_chosen_path": oracle.NEAR_DUPLICATES,
    "op11_lyndon_runs": oracle.RUNS}
