"""Mixing sources to target weights by weighted sampling without replacement.

A document's key is ``-ln(u) / weight`` with ``u`` uniform from a hash of seed and id (exponential keys after Efraimidis
and Spirakis): smaller keys come first, so better documents tend to. A source whose target exceeds its size is first
taken in complete epochs; the rest of the target is filled in key order up to a word budget. The prefix sum over a
source runs over ranges of keys, so no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Documents a key range holds on average.
RANGE_ROWS = 2_000
#: Weights are counted in so many steps to deal keys evenly over ranges; the order of keys does not depend on it.
STEPS = 8


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """A quality weight from 0.25 to 1: the square of the share of letters, spaces, and common punctuation."""
    whole = F.length(F.coalesce(text, F.lit("")))
    odd = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>!0-9_=+{}\[\]]"))
    return F.when(whole == 0, F.lit(0.25)).otherwise(F.greatest(F.lit(0.25), F.pow(1 - odd / whole, F.lit(2.0))))


def targets(sizes: list[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP):
    """Target per source: by weight, never above ``cap`` times its size; the excess is shared anew by weight.

    ``sizes`` come in source order; weights repeat along it. Returns a list in the same order.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left = share * sum(n for _, n in sizes)
    out = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total >= cap * sizes[i][1]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i][1]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = "mix",
    quality: Column | None = None,
    source: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Words taken per source equal its target rounded down; of the document that crosses the budget only the words that
    fit are taken. Null texts have size 0 and are taken 0 times. A null source is a source of its own, last in order.
    Ties of keys are broken by doc_id, then size; repeated rows are separate rows. The number of sources is small
    (their totals are gathered on the driver); an empty table gives an empty result.
    """
    spark = docs.sparkSession
    quality = quality_of(F.col("text")) if quality is None else quality
    # 52 bits of a digest: the same on every engine, exact as a double, never 0.
    uniform = (F.conv(F.left(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(
        "doc_id",
        F.col(source).alias("_source"),
        size_of(F.col("text")).alias("size"),
        (-F.ln(uniform) / quality).alias("_key"),
        F.least(F.lit(STEPS), F.greatest(F.lit(1), F.ceil(quality * STEPS))).cast("int").alias("_step"),
    )
    rows = written(rows, "mix-sizes")
    totals = rows.groupBy("_source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("_step") == k).alias(f"s{k}") for k in range(1, STEPS + 1))).collect()
    totals.sort(key=lambda r: (r["_source"] is None, [ord(c) for c in r["_source"] or ""]))
    goal = targets([(r["_source"], r["n"]) for r in totals], weights, share, cap)
    plan = []
    for r, t in zip(totals, goal):
        epochs = int(t // r["n"]) if r["n"] else 0
        plan.append((r["_source"] is None, r["_source"] or "", r["n"], float(t), epochs, int(t) - epochs * r["n"], -(-r["rows"] // RANGE_ROWS), [r[f"s{k}"] / r["rows"] for k in range(1, STEPS + 1)]))
    plan = spark.createDataFrame(plan, "_no boolean, _name string, source_size long, target double, _epochs long, _rest long, _ranges long, _steps array<double>")
    named = rows.withColumns({"_no": F.col("_source").isNull(), "_name": F.coalesce("_source", F.lit(""))}).join(F.broadcast(plan), ["_no", "_name"])
    # The share of a source's keys below a key, from its counted weights: rises with the key, so its ranges are key ranges.
    share_below = sum(((F.col("_steps")[k - 1] * (1 - F.exp(F.col("_key") * (-k / STEPS)))) for k in range(1, STEPS + 1)), F.lit(0.0))
    ranged = named.withColumn("_range", F.floor(share_below * F.col("_ranges"))).drop("_steps")
    ahead = ranged.groupBy("_no", "_name", "_range").agg(F.sum("size").alias("_in"))
    # One row per range: what comes before a range is the sum of a few thousand rows per million documents.
    before = Window.partitionBy("_no", "_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("_no", "_name", "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_no", "_name", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ahead, ["_no", "_name", "_range"])
    left = F.col("_rest") - F.col("_ahead") - F.col("_own")
    taken = F.col("size") * F.col("_epochs") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return summed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


_ODD = r"[#*$%&|<>!0-9_=+{}\[\]]"

#: Targets by rounds: sources at or above their cap leave with it, the rest share what is left.
ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(('0x' || left(md5('mix:' || doc_id), 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / CASE WHEN length(t) = 0 THEN 0.25::DOUBLE
                ELSE greatest(0.25::DOUBLE, pow(1 - len(regexp_extract_all(t, '{_ODD}')) / length(t)::DOUBLE, 2.0)) END AS k
  FROM docs
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         (list_value(5.0::DOUBLE, 2, 1))[1 + (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
), rounds(step, source, n, w, target, free, remaining) AS (
  SELECT 0, source, n, w, 0::DOUBLE, true, 1.5::DOUBLE * sum(n) OVER () FROM sources
  UNION ALL
  SELECT step + 1, source, n, w,
         CASE WHEN NOT free THEN target WHEN over THEN 2.0 * n ELSE remaining * w / wt END,
         free AND NOT over,
         remaining - coalesce(sum(CASE WHEN free AND over THEN 2.0 * n END) OVER (), 0)
  FROM (SELECT *, sum(CASE WHEN free THEN w END) OVER () AS wt,
               free AND remaining * w / sum(CASE WHEN free THEN w END) OVER () >= 2.0 * n AS over FROM rounds WHERE step < 60)
), goal AS (
  SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE floor(target / n) END::BIGINT AS e FROM rounds WHERE step = 60
), ordered AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * e + greatest(0, least(size, floor(target) - e * n - before)) AS BIGINT) AS taken
FROM ordered JOIN goal ON ordered.source IS NOT DISTINCT FROM goal.source
"""
