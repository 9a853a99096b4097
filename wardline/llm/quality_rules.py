"""Quality rules with thresholds that adapt to language and source.

Per (lang, source) and metric a mergeable quantile sketch is kept as counts of log-linear buckets (64 steps per power of
two, exact below 64), so sketches of parts add up to the sketch of the whole in any order and reruns agree. Fences from
its quartiles replace fixed cutoffs; documents meet their fences in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import GAP, let, words, written

SYMBOLS = r"[#*$%&|<>]"
#: Per metric: what it is scaled to as an integer, and the least distance of the fence from the upper (lower) quartile.
METRICS = {"m_word": 1_500, "m_symbols": 200, "m_lines": 200}
#: Fences lie so many interquartile ranges beyond the quartiles.
REACH = 6
#: Groups with fewer documents than this are judged by the sketch of their language, merged from its groups.
LEAST = 50
#: Up to so many rows of fences (three per group) are broadcast; more are joined by salted keys.
BROADCAST_FENCES = 50_000
SALTS = 64


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")),
        "n_repeat_words": repeat_words(text),
    }


def repeat_words(text: Column, n: int = 5) -> Column:
    """Words in ``n``-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash. Only texts that have a repeat at all sort their windows: equal hashes become
    neighbours, their starts are put in order, and each start adds the words up to the next one, ``n`` at most.
    """
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    grams = let(
        hashes,
        lambda h: F.when(F.size(h) < n, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))
        ),
    )

    def covered(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        starts = let(
            ordered,
            lambda s: F.sort_array(
                F.filter(
                    F.transform(
                        s,
                        lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"]),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(s, k + 1) - x, F.lit(n)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)).cast("long"))


def bucket_of(value: Column) -> Column:
    """The log-linear bucket of an integer, named by its least value."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by (lang, source, metric, bucket): bounded per group, and mergeable by adding."""
    flat = rows.select("_lang", "_source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("_m"))
    return flat.groupBy("_lang", "_source", F.col("_m.metric").alias("metric"), bucket_of(F.col("_m.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    own = Window.partitionBy(*keys, "metric")
    run = counts.withColumns({"_upto": F.sum("n").over(own.orderBy("bucket")), "_all": F.sum("n").over(own)})
    quartile = lambda k: F.min(F.when(4 * F.col("_upto") >= k * F.col("_all"), F.col("bucket")))
    found = run.groupBy(*keys, "metric").agg(quartile(1).alias("_q1"), quartile(3).alias("_q3"), F.max("_all").alias("_count"))
    slack = F.create_map(*(F.lit(x) for m in METRICS.items() for x in m))[F.col("metric")]
    away = REACH * (F.col("_q3") - F.col("_q1")) + slack
    return found.select(*keys, "metric", (F.col("_q1") - away).alias("low"), (F.col("_q3") + away).alias("high"), "_count")


def fences(counts: DataFrame) -> DataFrame:
    """low and high per (lang, source, metric): from the group's own sketch, or its language's where the group is small."""
    own = _fences(counts, ["_lang", "_source"])
    wide = _fences(counts.groupBy("_lang", "metric", "bucket").agg(F.sum("n").alias("n")), ["_lang"])
    wide = wide.select("_lang", "metric", F.col("low").alias("_low"), F.col("high").alias("_high"))
    joined = own.join(wide, ["_lang", "metric"])
    few = F.col("_count") < LEAST
    return joined.groupBy("_lang", "_source").agg(
        *(
            F.max(F.when(F.col("metric") == m, F.when(few, F.col(f"_{side}")).otherwise(F.col(side)))).alias(f"{m}_{side}")
            for m in METRICS
            for side in ("low", "high")
        )
    )


def judge(docs: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_FENCES) -> DataFrame:
    """``docs`` (lang, source and ``text`` among its columns) without ``text``, with the base columns, base_failed and kept.

    Null texts count as empty and fail. Null lang or source is a group of its own. Clashing columns are replaced, others
    stay, whatever their names. Texts are read whole, however long. Repeated rows are judged one by one; an empty table
    gives an empty result.
    """
    based = base_columns(F.col(text))
    rest = [c for c in docs.columns if c.lower() not in {*based, text.lower(), "base_failed", "kept"}]
    # What came in stays in one struct, where no name can clash.
    based = docs.select(
        F.struct(*(docs[c] for c in rest), F.lit(0).alias("_")).alias("_in"),
        F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("")).alias("_lang"),
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("_source"),
        *(c.alias(n) for n, c in based.items()),
    )
    based = based.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "m_word": F.expr("1000 * word_chars div greatest(n_words, 1)"),
            "m_symbols": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
            "m_lines": F.expr("1000 * n_dup_lines div greatest(n_words, 1)"),
        }
    )
    based = written(based, "quality")
    limits = written(fences(sketches(based.filter(~F.col("base_failed")))), "fences")
    if limits.count() <= broadcast_rows:
        met = based.join(F.broadcast(limits), ["_lang", "_source"], "left")
    else:
        # Rows of a hot group are dealt by the partition they lie in.
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = based.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(salted, ["_lang", "_source", "_salt"], "left")
    inside = [F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")) for m in METRICS]
    kept = ~F.col("base_failed") & inside[0] & inside[1] & inside[2]
    return met.select(
        *(F.col(f"_in.`{c}`").alias(c) for c in rest), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(kept, F.lit(False)).alias("kept"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs).select("doc_id", *names)


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s FROM documents
), cut AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), grams AS (
  SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM cut)
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeats AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
    (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
), based AS (
  SELECT cut.doc_id, l, s, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN repeats USING (doc_id)
), metrics AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         1000 * word_chars // greatest(n_words, 1) AS m_word, 1000 * n_symbols // greatest(n_words, 1) AS m_symbols,
         1000 * n_dup_lines // greatest(n_words, 1) AS m_lines
  FROM based
), flat AS (
  SELECT l, s, unnest([{'m': 'm_word', 'v': m_word, 'k': 1500}, {'m': 'm_symbols', 'v': m_symbols, 'k': 200},
                       {'m': 'm_lines', 'v': m_lines, 'k': 200}]) AS x
  FROM metrics WHERE NOT base_failed
), counts AS (
  SELECT l, s, x.m AS m, x.k AS k,
         (x.v >> greatest(0, length(bin(x.v)) - 7)) << greatest(0, length(bin(x.v)) - 7) AS b, count(*) AS n
  FROM flat GROUP BY ALL
), own AS (
  SELECT l, s, m, k, min(CASE WHEN 4 * upto >= al THEN b END) AS q1, min(CASE WHEN 4 * upto >= 3 * al THEN b END) AS q3, max(al) AS al
  FROM (SELECT *, sum(n) OVER (PARTITION BY l, s, m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY l, s, m) AS al FROM counts)
  GROUP BY ALL
), wide AS (
  SELECT l, m, min(CASE WHEN 4 * upto >= al THEN b END) AS w1, min(CASE WHEN 4 * upto >= 3 * al THEN b END) AS w3
  FROM (SELECT *, sum(n) OVER (PARTITION BY l, m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY l, m) AS al
        FROM (SELECT l, m, b, sum(n) AS n FROM counts GROUP BY ALL)) GROUP BY ALL
), limits AS (
  SELECT l, s, m, CASE WHEN al < 50 THEN w1 - 6 * (w3 - w1) - k ELSE q1 - 6 * (q3 - q1) - k END AS low,
         CASE WHEN al < 50 THEN w3 + 6 * (w3 - w1) + k ELSE q3 + 6 * (q3 - q1) + k END AS high
  FROM own JOIN wide USING (l, m)
)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND m_word BETWEEN a.low AND a.high AND m_symbols BETWEEN b.low AND b.high
                AND m_lines BETWEEN c.low AND c.high, false) AS kept
FROM metrics d
LEFT JOIN limits a ON a.l = d.l AND a.s = d.s AND a.m = 'm_word'
LEFT JOIN limits b ON b.l = d.l AND b.s = d.s AND b.m = 'm_symbols'
LEFT JOIN limits c ON c.l = d.l AND c.s = d.s AND c.m = 'm_lines'
"""
