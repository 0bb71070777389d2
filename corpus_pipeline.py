"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Quality rules drop documents; near-dedup keeps one document of each group; personal data
is masked in the texts; mixing repeats or drops documents by their rates; packing places
what is left into sequences, one row per piece.
"""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from regspark.llm import mixing, neardup, packing, pii, quality
from regspark.llm.common import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("minhash_neardup", minhash_neardup), ("pii", mask_pii),
          ("mixing", mix_sources), ("packing", pack_sequences)]

# The language model, the trained classifiers and the tokenizer are outside of SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
