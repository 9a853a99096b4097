"""The corpus pipeline: language ID, near-duplicate removal, decontamination, masking of personal data, and mixing.

Stages read whole texts, however long, take empty tables (and give empty ones), null values in any column, and repeated
rows, and hand on further columns, whatever their names; the last returns the columns of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontamination, language_id, mixing, near_dedup, private_data
from wardline.llm.shared import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told (null texts among them); fills in lang where it is null."""
    return language_id.with_language(docs, language_id.fit(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that of the least id, rows without id last; rows that share an id stay
    unless their texts are alike."""
    return near_dedup.deduplicate(docs, k=5)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null texts hold none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text, null texts stay null."""
    return private_data.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; a null source is one of its own, a null text has no words."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicate removal", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("personal data", mask_private_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
