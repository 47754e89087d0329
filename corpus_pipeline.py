"""A training corpus from raw documents: quality, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its output is written as Parquet and
read again.  All stages but the last return the columns of documents; the last returns, for each document in the token files,
doc_id, start, n_tokens and ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import decontaminate, mixing, near_text, quality, tokenfile
from quernel.llm.queries import tokenizer_path
from quernel.llm.shared import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.quality_scorer(docs, labels), threshold=0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return near_text.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the rates, 1 at most, that bring the domains nearest to their target weights by the token ids of the next stage."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rate=1.0, tokenizer=tokenizer_path())


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is encoded into token files, and their boundaries are read back."""
    return tokenfile.read_tokens(tokenfile.write_tokens(docs, tokenizer_path(), end_id=1))


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-id output", token_stage),
]

#: classifiers, signatures and a tokenizer are beyond SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(spark, docs, f"stage-{i + 1}")
    return docs
