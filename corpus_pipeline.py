"""From raw documents to a training mix: five stages, each one of the training-data operators.

Every stage works on all that the one before kept, and is written before the next begins, so a lost
executor or a new run costs one stage. All stages but the last return the columns of `documents`; the
last returns the mix: one row for each document that it takes, with the words it takes from it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontam, mixing, quality_classifier, secret_scan, simhash_wide
from linkloom.shared import drop_shared, reach_workers, written_alone


def _stage(work):
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return work(spark, docs, sf_dir)

    return run


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8 or more."""
    return simhash_wide.without_near_duplicates(docs)


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret's span replaced by its kind."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target weights take from each document."""
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix),
]

#: Fitted models and similarity groups are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows as a table in the shared folder; tables that no later stage reads are deleted."""
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = written_alone(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if docs is not given:
            drop_shared(docs)
        docs = kept
    return docs
