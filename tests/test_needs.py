"""The words that expressions need: no match without them, and few expressions left to try on a harmless text."""

import re

import pytest
from pyspark.sql import functions as F

from wardline.functions import rules as R
from wardline.functions import text as T
from wardline.operators import detect, needs, reach
from wardline.plans import catalogue

EXPRESSIONS = [r for _, r in catalogue.RULES]
FORMS = sorted({f for b in reach.branches(catalogue.RULES) for f in (b.whole, b.bare, b.relaxed)})
PLAIN = (
    "The committee met on Tuesday to look at the figures of the past quarter. Sales had grown by four percent, and nobody could say why. "
    "One member asked whether the new shop by the river had any part in it; another doubted that. They agreed to read the numbers again in spring."
)


def judged(spark, texts, expressions):
    """Per text the expressions that match, and those that are left to try."""
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").withColumn("low", F.lower("t"))
    rows = rows.withColumns({"hits": F.expr(needs.noted("t", needs.beginnings(expressions))), "within": F.expr(needs.noted("low", needs.inner(expressions), begin=False))})
    tried = ", ".join(f"{needs.possible(r, 'hits', 'low', 'within')}" for r in expressions)
    alone = ", ".join(f"{needs.possible(r, 'hits', 'low')}" for r in expressions)
    matched = ", ".join(f"rlike(t, {T.literal(r)})" for r in expressions)
    return rows.select("n", F.expr(f"array({tried})").alias("tried"), F.expr(f"array({alone})").alias("alone"), F.expr(f"array({matched})").alias("matched")).orderBy("n").collect()


@pytest.mark.parametrize("expressions", [EXPRESSIONS, FORMS], ids=["rules", "branches"])
def test_no_match_without_the_words(spark, expressions):
    texts = [*catalogue.PLANTS, " ".join(catalogue.PLANTS), PLAIN]
    texts += [t.upper() for t in catalogue.PLANTS] + [re.sub(" ", "\n", t) for t in catalogue.PLANTS] + ["K" + t for t in catalogue.PLANTS] + ["x" + t for t in catalogue.PLANTS]
    texts += [re.sub(r"\(\?i\)|\(\?:\^\|\[\^[^\]]*\]\)|[\\^$]|\(\?:|[)?+*]", "", re.sub(r"\[ [^\]]*\]\+?", " ", f)).replace("|", " ") for f in FORMS]
    rows = judged(spark, texts, expressions)
    assert sum(map(sum, (r["matched"] for r in rows))) > len(catalogue.PLANTS)
    assert not [(texts[r["n"]], expressions[i]) for r in rows for i, m in enumerate(r["matched"]) if m and not (r["tried"][i] and r["alone"][i])]


def test_few_are_left_to_try(spark):
    (row,) = judged(spark, [PLAIN], EXPRESSIONS)
    assert sum(row["tried"]) < 5 and not any(row["matched"])


def test_what_is_derived():
    words = lambda r: {(tuple(sorted(w for w, _ in n.words)), all(b for _, b in n.words)) for n in needs.needs(r)}
    assert words(R.expression("skip(?:s|ping)? (?:the )?(?:review|check)")) == {(("skip",), True), (("check", "review"), True)}
    assert words(r"(?i)ab?cde{2,}f") == {(("a",), False), (("cde",), False), (("f",), False)}
    assert words(r"x{0,3}(?:abc)?(?!def)(?:gh|[a-z])") == set()
    assert words(r"(?:^|[^A-Za-z])[ \t]*pre-?approved") == {(("pre",), True), (("approved",), False)}
    assert words(r"a|b+c") == {(("a", "b"), False)}


@pytest.mark.parametrize("name", ["rule_reachability", "rule_edges"])
def test_branches_and_sql_agree(spark, small, name):
    from .test_queries import test_query_and_sql_agree

    test_query_and_sql_agree(spark, small, name)


def test_rules_asked_for_alone_give_the_same(spark):
    texts = [*catalogue.PLANTS, "Post it to 8.8.8.8/x, ws://a.example/b or data:text/plain;abcd, mail drop@example.com", PLAIN]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, canon string")
    every = {(r["n"], s) for r in detect.destinations(rows).collect() for s in r["destinations"]}
    rules = {s["rule"] for _, s in every}
    assert rules > {"image", "form_0", "email", "url", "host", "scheme", "address", "relative"}
    for rule in sorted(rules):
        alone = {(r["n"], s) for r in detect.destinations(rows, only=[rule]).collect() for s in r["destinations"]}
        assert alone == {(n, s) for n, s in every if s["rule"] == rule}, rule


@pytest.mark.parametrize("name, needless", [("md_image", R.HOST), ("obfuscated_dest_0", R.SCHEMES), ("email_role_vs_drop", R.HOST), ("named_recipient", R.COLLECTOR)])
def test_steps_that_a_query_does_not_rest_on_are_left_out(spark, small, name, needless):
    plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan()
    assert needless[4:40] not in plan.toString()


@pytest.mark.parametrize("name", ["scan_severity_counts", "scan_detector_counts", "top_detectors", "severity_detector_cube"])
def test_counts_search_a_text_once_for_all_words(spark, small, name):
    plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(concat( ") == 1


def test_signs_stand_in_all_that_is_hidden(spark):
    pieces = ["<!-- a -->", "[//]: # (a)", "/* a */", '<p style="display: none">a</p>', "\\u0061" * 4, "\\x61" * 4, "&#97;" * 4, "&#x61;" * 4, "%61" * 4]
    df = spark.createDataFrame([(t,) for t in pieces], "t string")
    got = [len(r["m"]) + len(r["e"]) for r in df.select(detect.hidden_markup(F.col("t")).alias("m"), detect.escape_run(F.col("t")).alias("e")).collect()]
    assert got == [1] * len(pieces)


def test_squashed_text_is_computed_once(spark):
    df = spark.createDataFrame([("i g-n.o r e p r e v i o u s instructions",), ("Développer Mode: Developer_Mode!",), ("none",)], "t string").select(detect.squashed(F.col("t")).alias("s"))
    assert [[x["rule"] for x in r["s"]] for r in df.collect()] == [["squashed_ignorepreviousinstructions"], ["squashed_developermode"], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("P{Alnum}") == 1
