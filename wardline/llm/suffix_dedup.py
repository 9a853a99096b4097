"""Suffix-array dedup on bytes, suffixes sorted by linear grouping.

Suffixes are sampled at anchors. What follows each anchor and, reversed, what precedes it are strings of byte blocks
whose suffixes are sorted by linear grouping; equal windows are read off from how far neighbours in these orders agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import resolve
from .windows import ByteArrays


def remove_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the bytes left), and removed (maximal runs of removed bytes: start, end) for
    every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes of its document covers it that also starts earlier: in a smaller doc_id,
    or earlier in the same document. Null and empty texts have no bytes; shorter texts lose nothing. Rows with equal
    doc_id are in order of their text, equal rows in any. Null doc_ids come last, in any order among themselves. A task
    holds one chunk of documents, about ``anchors.CHUNK_BYTES`` of text or one document that is longer, some forty times
    over.
    """
    return resolve(docs, ByteArrays(length, max(1, 52 * length // 100)), "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:bigint,end:bigint>>")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
