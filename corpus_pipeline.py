"""The training-data pipeline over `documents`: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, minhash, quality, surrogates
from ledgerloom.llm.common import read, save

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    judged = quality.quality_rules(docs, read(spark, sf_dir, "labels"))
    return judged.where(judged[judged.columns[-1]]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that mostly consist of them go."""
    return decontaminate.remove_benchmark(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    return surrogates.replace_pii(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and token_ids; text is what the ids decode to."""
    out = bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))
    n_tokens, ids, decoded = out.columns[-3:]
    text = F.when(F.col("text").isNotNull(), F.col(decoded)).alias("text")
    return out.select(*[text if c == "text" else c for c in docs.columns], n_tokens, ids)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("pii", pii), ("tokens", tokens)]

# fitted models, random trees and a tokenizer are not for SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
