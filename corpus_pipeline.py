"""From raw documents to a training mixture: five stages, each written and read again before the next.

Documents that the perplexity model of trusted text rejects go; of near-duplicates one stays; documents that hold a
benchmark passage go; personal data is masked; and the rest is repeated so that the languages' tokens meet their weights.
Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.llm import kneser_ney, mixing, order_minhash, pii, winnowing
from firmament.llm.common import materialize, table
from firmament.llm.queries import DOMAIN_WEIGHTS, trusted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the model accepts."""
    return kneser_ney.keep_accepted(docs, trusted(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return order_minhash.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents without a benchmark passage."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, scarce languages repeated; ``rate`` and ``copy`` are added."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), DOMAIN_WEIGHTS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixture", mixture)]

ORACLE_SQL = None  # the model, the sketches and the transducers have no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
