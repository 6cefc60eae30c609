"""The corpus pipeline: rules, near-duplicates, secrets, mixing and token ids.

Every stage gets the documents that the one before it kept, from the first on with the
columns of ``documents``; the last adds the number of tokens and the token ids.  ``run``
writes each stage into the shared folder and reads it back.

A null text passes the later stages as the empty text (the rules reject it); repeated
rows, empty tables and further columns are defined by the operators.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import public_tokenizers  # noqa: E402

from chunkframe.llm import byte_bpe, mixing, near_text, quality_rules, secret_scan  # noqa: E402
from chunkframe.llm._common import written  # noqa: E402

RANKS = "byte_bpe_50k.tiktoken"
#: No source is repeated more often than this over the one that is repeated least.
MAX_REPETITION = 1.25


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles one stays;
    SimHash fingerprints in BK-trees name the candidates."""
    return near_text.dedupe(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to the target weights of their sources; all stay."""
    return mixing.realise(docs, max_repetition=MAX_REPETITION, budget_ratio=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are added."""
    return byte_bpe.encode(docs, public_tokenizers.path(RANKS), outputs=("n_tokens", "ids"))


STAGES = [("quality_rules", rules), ("simhash_near_dedup", near_duplicates), ("secret_scan", secrets), ("temperature_mixing", mix), ("byte_bpe", encode)]

#: Fingerprints and byte-pair merges can't be stated in SQL; tests hold ``run`` against a
#: plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
