"""URL filtering by rules on host suffixes and path prefixes.

Every URL is expanded into the (host suffix, path prefix) expressions a rule could name. Expressions meet the rules in
an equi-join on a short prefix of their SHA-256 digest; the full digest confirms a hit, and the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rule tables up to this many rows are broadcast; larger ones are shuffled on the digest prefix.
BROADCAST_RULES = 100_000
#: A host and path that many rows share is joined in so many parts.
SALTS = 32


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """verdict, rule, digest, short and the lengths that say which expressions can hit. Equal rules: block wins."""
    rows = spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")
    rows = rows.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    expression = F.concat("rule_host", F.lit("\n"), "rule_path")
    return rows.select(
        "verdict",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.sha2(expression, 256).alias("digest"),
        F.left(F.sha2(expression, 256), F.lit(8)).alias("short"),
        F.length("rule_path").alias("path_length"),
    )


def filter_urls(
    df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rows: int = BROADCAST_RULES
) -> DataFrame:
    """``df`` with host, path, rule and verdict; clashing columns of ``df`` are replaced.

    Null and empty URLs have no host and no path, so no rule fits and ``default`` decides. A path that is empty starts
    with no rule's path. Repeated rows are judged one by one; the row count never changes; an empty table gives an empty
    result. URLs and rules may be of any length. The distinct lengths of the rules' paths are gathered on the driver:
    as many as there are take rules of at least half their square in characters.
    """
    df = df.drop(*(c for c in ("host", "path", "rule", "verdict") if c != url))
    host, path = split_url(F.col(url))
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())
    count = rules.count()
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    keyed = df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), host.alias("host"), path.alias("path"), salt.alias("_salt"))
    # A host and path are judged once, however many rows have them: a hot pair does not multiply the expansion.
    pairs = keyed.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # One array of lengths, so the plan does not grow with the rules.
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    seen = (
        pairs.select("host", "path", F.explode(suffixes).alias("_s"), F.transform(fitting, lambda n: F.left("path", n)).alias("_p"))
        .select("host", "path", "_s", F.explode("_p").alias("_p"))
        .select("host", "path", F.sha2(F.concat("_s", F.lit("\n"), "_p"), 256).alias("_digest"))
        .withColumn("short", F.left("_digest", F.lit(8)))
    )
    side = F.broadcast(rules) if count <= broadcast_rows else rules
    hits = seen.join(side, "short").filter(F.col("_digest") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.col("verdict").alias("v"), F.col("rule").alias("r"))).alias("_hit")
    )
    out = keyed.join(best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "path", "_salt"], "left")
    return out.select(
        *(F.col(f"_row.`{c}`").alias(c) for c in df.columns),
        "host",
        "path",
        F.col("_hit.r").alias("rule"),
        F.coalesce("_hit.v", F.lit(default)).alias("verdict"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = filter_urls(pages, rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLE_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(v, h, p) AS (VALUES {_VALUES}),
hits AS (
  SELECT page_id, v, h || p AS r,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, v DESC) AS nth
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, r AS rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE nth = 1) USING (page_id)
"""
