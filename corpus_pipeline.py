"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as
Parquet and hands what it rereads to the next stage, so a lost executor costs no more
than a stage.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsweave.llm import decontaminate, line_quality, mixing, order_minhash, token_files
from opsweave.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that are common in their host leave the rest."""
    return line_quality.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return order_minhash.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, as it is or with other parameters, go."""
    return decontaminate.without_leaks(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and what they hold per document."""
    vocabulary, out = public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "pipeline-tokens")
    token_files.write_token_files(docs, out, vocabulary)
    return token_files.read_token_files(spark, out, vocabulary)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token output", token_output),
]

# Tokens cannot be counted in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
