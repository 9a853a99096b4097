"""Combination of weak signals per unit, and reports over findings.

A findings table has one row per finding: unit columns, detector, severity, rule, excerpt. A unit's categories are one
bitmask; the first damning pair it contains makes a composite, else three categories do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def category_bit(detector: Column) -> Column:
    """The detector's category as a bit; detectors that do not combine give 0."""
    cases = None
    for d, c in sorted(R.CATEGORY_OF.items()):
        cases = F.when(detector == d, R.BIT[c]) if cases is None else cases.when(detector == d, R.BIT[c])
    return cases.otherwise(0)


def reason(mask: Column) -> Column:
    """Why a set of categories is damning, or null."""
    cases = None
    for pair, why in R.DAMNING:
        bits = sum(R.BIT[c] for c in pair)
        hit = mask.bitwiseAND(bits) == bits
        cases = F.when(hit, why) if cases is None else cases.when(hit, why)
    return cases.when(F.bit_count(mask) >= 3, R.MANY)


def units(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per unit: mask of categories, n findings, max severity, and the composite's reason. One shuffle, combined map-side."""
    own = findings.filter(F.col("detector") != "composite")
    return own.groupBy(*keys).agg(
        F.bit_or(category_bit(F.col("detector"))).alias("mask"), F.count(F.lit(1)).alias("n"), F.max("severity").alias("max_severity")
    ).withColumn("reason", reason(F.col("mask")))


def combine(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The findings without old composites, and one new composite per damning unit."""
    own = findings.filter(F.col("detector") != "composite")
    made = units(findings, keys).filter("reason IS NOT NULL").select(
        *keys, F.lit("composite").alias("detector"), F.lit(R.CRITICAL).alias("severity"), F.lit("composite").alias("rule"), F.col("reason").alias("excerpt")
    )
    return own.select(*keys, "detector", "severity", "rule", "excerpt").unionByName(made)


def combine_texts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``combine`` for units that are one text each, with the findings computed once: a text's findings, which its length
    bounds, meet in one row. Units of unbounded size go through ``combine``."""
    one = F.struct("detector", "severity", "rule", "excerpt")
    met = findings.filter(F.col("detector") != "composite").groupBy(*keys).agg(F.collect_list(one).alias("_all"), F.bit_or(category_bit(F.col("detector"))).alias("_mask"))
    why = reason(F.col("_mask"))
    made = F.struct(F.lit("composite").alias("detector"), F.lit(R.CRITICAL).alias("severity"), F.lit("composite").alias("rule"), why.alias("excerpt"))
    return T.expand(met, keys, F.concat("_all", F.when(why.isNotNull(), F.array(made)).otherwise(F.slice("_all", F.lit(1), F.lit(0)))))


def levels(findings: DataFrame, text_keys: list[str], action_keys: list[str], toolkit_keys: list[str]) -> DataFrame:
    """Composites at three levels in one pass: per text, per action, and per toolkit (grouping sets over one mask)."""
    bits = findings.filter(F.col("detector") != "composite").withColumn("bit", category_bit(F.col("detector")))
    sets = [toolkit_keys, toolkit_keys + action_keys, toolkit_keys + action_keys + text_keys]
    every = sets[-1]
    columns = [F.col(c) for c in every]
    grouped = bits.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.bit_or("bit").alias("mask"), F.grouping_id().alias("level"))
    return grouped.withColumn("reason", reason(F.col("mask"))).filter("reason IS NOT NULL")


def at_or_above(findings: DataFrame, level: int) -> DataFrame:
    return findings.filter(F.col("severity") >= level)


def blocked(findings: DataFrame, keys: list[str], level: int = R.CRITICAL) -> DataFrame:
    """The units with a finding at the level or above."""
    return at_or_above(findings, level).select(*keys).distinct()


def usable(units_df: DataFrame, findings: DataFrame, keys: list[str], level: int = R.CRITICAL) -> DataFrame:
    """The units with no finding at the level or above."""
    return units_df.join(blocked(findings, keys, level), keys, "left_anti")


def scanned_chars(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per unit the code points that were scanned; a null text has none."""
    return texts.groupBy(*keys).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("scanned_chars"))


def report(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The findings of each unit in the order of a report: nth (from 1), the gravest first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("severity"), "detector", "rule", "excerpt")
    return findings.withColumn("nth", F.row_number().over(order))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def detector_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


def top_detectors(findings: DataFrame, k: int = 5) -> DataFrame:
    return detector_counts(findings).orderBy(F.desc("n"), "detector").limit(k)


def severity_cube(findings: DataFrame) -> DataFrame:
    """severity x detector with all totals (an extension)."""
    return findings.cube("severity", "detector").agg(F.count(F.lit(1)).alias("n"))


def summary(unit_rows: DataFrame, findings: DataFrame, keys: list[str], group: str) -> DataFrame:
    """One row: groups, units, quiet units, units at HIGH and above, findings. No names in it."""
    worst = findings.groupBy(*keys).agg(F.max("severity").alias("worst"), F.count(F.lit(1)).alias("found"))
    return unit_rows.select(*keys, group).join(worst, keys, "left").agg(
        F.countDistinct(group).alias("groups"),
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("worst").isNull()).alias("quiet"),
        F.count_if(F.col("worst") >= R.HIGH).alias("at_high"),
        F.coalesce(F.sum("found"), F.lit(0)).cast("long").alias("findings"),
    )
