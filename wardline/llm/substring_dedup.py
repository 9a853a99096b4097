"""Substring dedup on words with prefix-partitioned suffix trees.

Suffixes are dealt to groups, as many as the input is large, by the first words of the suffix sampled in each window.
Within a group, word prefixes of variable length split the suffixes of all windows until each part's leaves fit a bound;
a part's subtree is built from its sorted leaves, and its inner nodes at window depth or deeper are the repeats: all of
a node's leaves but the earliest are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import resolve
from .windows import WordTrees


def remove_repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), and removed (runs of removed words: start,
    end) for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` consecutive words of its document covers it whose words also start earlier: in
    a smaller doc_id, or earlier in the same document. Null and empty texts have no words; texts shorter than a window
    lose nothing. Rows with equal doc_id are in order of their text, equal rows in any. Null doc_ids come last, in any
    order among themselves. A task holds one chunk of documents, about ``anchors.CHUNK_BYTES`` of text or one document
    that is longer, some ten times over.
    """
    return resolve(docs, WordTrees(window, max(1, 2 * window // 5)), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:bigint,end:bigint>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
