"""Sources and sinks: tool catalogues, ledgers as JSON lines, literal corpora, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decode

ENTRY = "seq long, ts string, prev string, kind string, action string, decision string, reason string, payload_digest string, findings array<string>, meta string, digest string"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """toolkit, action, description, payload from one JSON object of ``toolkit--id--action`` keys; the toolkit is the key
    without its last part. Values are a description, or an object with description and payload."""
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    v = F.try_parse_json("raw")
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    payload = F.try_variant_get(v, "$.payload", "string")
    inner = F.try_parse_json(payload)
    unwrapped = F.coalesce(F.to_json(F.try_variant_get(inner, "$.properties", "variant")), F.when(inner.isNotNull(), payload))
    return entries.select(
        F.regexp_replace("key", "--[^-]+(?:-[^-]+)*$", "").alias("toolkit"),
        F.element_at(F.split("key", "--"), -1).alias("action"),
        F.when(whole, F.try_variant_get(v, "$.description", "string")).otherwise(F.col("raw")).alias("description"),
        F.when(whole, unwrapped).alias("payload"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines ledger with file and line (from 0); lines that are no entry keep nulls, blank lines are left out.

    Files are read by lines and split like any other. A line's number is its place in its split and the lines of the
    splits before, of which there is one row each.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"))
    first = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    rows = lines.filter(F.trim("value") != "").join(first, ["file", "block"])
    parsed = rows.select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), F.from_json("value", ENTRY).alias("e"))
    return parsed.select("file", "line", "e.*").fillna({"reason": "", "payload_digest": ""})


def write_ledger(sealed: DataFrame, path: str, chain: str | None = None) -> None:
    """Appends sealed entries as JSON lines, each chain in order in one file: all in one, or dealt by ``chain``."""
    dealt = sealed.coalesce(1).sortWithinPartitions("seq") if chain is None else sealed.repartition(F.col(chain)).sortWithinPartitions(chain, "seq")
    dealt.write.mode("append").json(path)


def read_literals(spark: SparkSession, path: str, least: int = 8) -> DataFrame:
    """file, literal: string literals of source files, ``least`` characters or longer, and those with escapes once more
    as the escapes read."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    found = files.select("file", F.explode(F.regexp_extract_all("value", F.lit(r'"((?:[^"\\\n]|\\.)*)"' + r"|'((?:[^'\\\n]|\\.)*)'"), F.lit(0))).alias("literal"))
    found = found.select("file", F.expr("substr(literal, 2, length(literal) - 2)").alias("literal")).filter(F.length("literal") >= least)
    own = F.col("literal")
    read = F.when(own.rlike(r"\\[uxU]"), F.array_distinct(F.array(own, decode.unescaped(own)))).otherwise(F.array(own))
    return found.select("file", F.explode(read).alias("literal"))


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON file of an aggregate; the aggregates here hold no names."""
    summary.coalesce(1).write.mode("overwrite").json(path)
