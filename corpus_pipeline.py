"""A corpus from raw documents to token shards in five stages, each written as Parquet and read again as the next one's input.

Defined results, as of the operators: null and empty texts fail the base rules of the first stage; rows without id are kept as
rows of their own; repeated rows are one document after near_dedup, and of equal ids one stays; empty tables go through all
stages as such; other columns are carried up to mix_sources; very long texts are rows like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import decontamination, mixing, quality, simhash, sstable
from tradewind.llm.common import intermediates, new_folder, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and epoch."""
    return mixing.take_mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token-id shards and returns what they hold of each document."""
    folder = new_folder(spark, "corpus")
    manifest = sstable.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return sstable.scan_shards(spark, manifest, folder)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token shards", token_shards),
]

#: Fingerprints, learned rules and tokenization are beyond SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage wrote on its way goes once its result, or the next one's, is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
