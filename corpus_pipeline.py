"""A training-data pipeline over ``documents``: five stages, each an operator of ``tidemark.llm``.

Every stage but the last returns the columns of documents; ``run`` writes each stage's rows to the shared
folder and reads them again as the next one's input.

Defined results: null, empty and short texts fail the base rules and go in the first stage; texts of any length are
judged whole; of rows with an equal text the smallest doc_id stays, of repeated rows (equal doc_id) all do, and each row
with a null doc_id; an empty table gives an empty result; without labels only the base rules count, without test
items no document is dropped for one; other columns, whatever their names, are kept up to the last stage; ``n_chars``
needn't be there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, near_dedup, quality, registry, secrets
from tidemark.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each group the smallest doc_id stays."""
    return near_dedup.keep(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, and their decoding."""
    return bpe.codec_rows(docs, public_tokenizers.path(registry.RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: The quality model is trained, which SQL can't express; a test computes the whole chain by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
