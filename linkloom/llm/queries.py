"""The `opN_<name>` queries: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontam, html_text, langid, lm_score, mixing, oracle, quality_classifier, quality_rules, secret_scan, simhash, token_counts
from linkloom.shared import shared_folder

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("LINKLOOM_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one insert batch, committed twice: the second commit changes nothing."""
    tokenizer = token_counts.Tokenizer.read(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "byte_bpe_50k")
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    rows = token_counts.counted(_table(spark, sf_dir, "documents"), tokenizer)
    for _ in range(2):
        rollup.commit("load", rows)
    return rollup.totals()


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score_documents(_table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_html_text, op2_decontaminate, op3_mix_sources, op4_secret_scan, op5_token_counts, op6_quality_classifier, op7_lm_score, op8_langid, op9_simhash, op10_quality_rules)}

#: Where SQL can state the rows; the other operators are tested against brute force.
ORACLE_SQL: dict[str, str] = oracle.SQL
