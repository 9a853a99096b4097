"""Operators 3, 4, 5, 6, 7 and 10 against plain Python, SQL, or held-out accuracy."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wardline.llm import decontamination, language_id, mixing, near_dedup, private_data, quality_rules


def docs_of(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


# 3: personal data


TRICKY = [
    "mail a.b+c@x-y.example.com, or d@e.f; bad@host and @x.y and a@b@c.d",
    "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0001.02.3.4 v1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111111 and 4111  1111",
    "+49 (30) 123-4567 and +1 2 and ++4912345678901 +4 9 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "x@y.z" * 50,
    "é+49 170 1234567 漢 a@b.cd 😀 10.0.0.1",
    "-" * 3000 + "@",
    "1" * 4000,
    None,
    "",
]


def test_base_spans_match_the_patterns(spark, small):
    docs = docs_of(spark, small) + [(10_000 + i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in private_data.find(df).collect():
        text = dict(docs)[r["doc_id"]]
        want = brute.base_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == brute.sha(joined), (r["doc_id"], joined)
        assert tuple(r[f"n_{k}"] for k in brute.KINDS) == tuple(sum(x[0] == k for x in want) for k in brute.KINDS)
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {(k, int(s), int(e)) for k, s, e in spans} >= set(want)
        assert all(0 <= int(s) < int(e) <= len(text) for _, s, e in spans)


def test_patterns_discover_what_base_patterns_miss(spark):
    docs = [(i, f"please dial kontaktnummer +49 170 12345{i:02d} today, whoever reads this") for i in range(40)]
    docs += [(100 + i, f"please dial kontaktnummer 0170-12345{i:02d} today") for i in range(5)]
    # Other digits: the same ones would make "number" a pattern of the second generation.
    docs += [(200 + i, f"section number 0171-98765{i:02d} of the book") for i in range(5)]
    rows = {r["doc_id"]: r for r in private_data.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(5):
        at = docs[40 + i][1].index("0170")
        assert rows[100 + i]["spans"] == f"phone:{at}:{at + 12}" and rows[100 + i]["n_phone"] == 0
        assert rows[200 + i]["spans"] == ""


def test_numbers_in_groups_and_long_words_are_discovered(spark):
    docs = [(i, f"please dial kontaktnummer +49 170 12345{i:02d} today, or kontaktmail p{i}@q.example") for i in range(60)]
    long = "x" * 90 + "@localhost"
    cases = {
        "kontaktnummer: 030 123 4567 today": ["phone:030 123 4567"],
        "kontaktnummer (555) 123-4567, today": ["phone:(555) 123-4567"],
        "kontaktnummer 0049 30 1234 5678. 24 hours": ["phone:0049 30 1234 5678"],
        "kontaktnummer 030 123 4567 10.0.0.1": ["phone:030 123 4567", "ip:10.0.0.1"],
        "kontaktnummer 0301234567 10.0.0.1": ["phone:0301234567", "ip:10.0.0.1"],
        "kontaktnummer 030.123.4567\t2021": ["phone:030.123.4567"],
        "kontaktnummer 030 123 4567 890 123 4567 890": ["phone:030 123 4567 890"],
        "the section 030 123 4567 of the book": [],
        f"kontaktmail {long} today": [f"email:{long}"],
    }
    docs += [(100 + i, t) for i, t in enumerate(cases)] + [(300, "kontaktnummer " + "1 " * 4000), (301, "1" * 9000 + " " + "(1) " * 3000 + "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in private_data.find(df).collect()}
    for i, (text, want) in enumerate(cases.items()):
        spans = [x.split(":") for x in rows[100 + i].split(",") if x]
        assert [f"{k}:{text[int(s) : int(e)]}" for k, s, e in spans] == want, text
    out = {r["doc_id"]: r["text"] for r in private_data.masked(df).collect()}
    assert out[100] == "kontaktnummer: <PHONE> today" and out[103] == "kontaktnummer <PHONE> <IP>"


def test_masking_keeps_everything_else(spark):
    docs = [(1, "write a@b.example or 10.0.0.1 now", "x"), (2, None, "y"), (3, "nothing here", None), (None, "c@d.example", "z"), (1, "write a@b.example or 10.0.0.1 now", "x"), (1, "", None)]
    for names in (("_spans", "_id", "_key"), ("_in", "_row", "cands"), ("email", "extra", "_text"), ("left", "kind", "hit")):
        df = spark.createDataFrame([(d, t, n, 1, "k") for d, t, n in docs], ", ".join(["doc_id long", "text string", f"`{names[0]}` string", f"`{names[1]}` int", f"`{names[2]}` string"]))
        masked = private_data.masked(df)
        assert masked.columns == df.columns
        out = sorted(((r["doc_id"] or 9, r["text"], r[names[0]], r[names[1]], r[names[2]]) for r in masked.collect()), key=str)
        want = [(1, "write <EMAIL> or <IP> now", "x")] * 2 + [(1, "", None), (2, None, "y"), (3, "nothing here", None), (9, "<EMAIL>", "z")]
        assert out == sorted([(*w, 1, "k") for w in want], key=str)
    assert private_data.masked(df.filter("false")).count() == 0 and private_data.find(df.filter("false")).count() == 0


def generations(mentions):
    """{(left, kind): confidence} of the sure patterns, of [(left, kind, hit, seed, texts of left)] of one row each."""
    edges = {}
    for left, kind, hit, seed in mentions:
        edges[left, kind, hit] = max(seed, edges.get((left, kind, hit), 0))
    score = {}
    for (_, kind, hit), seed in edges.items():
        score[kind, hit] = max(seed, score.get((kind, hit), 0))
    found = {}
    for _ in range(private_data.ROUNDS):
        found = {}
        for left, kind in {x[:2] for x in edges}:
            own = [score[kind, h] for a, k, h in edges if (a, k) == (left, kind)]
            if sum(x >= private_data.SURE for x in own) >= private_data.SEEDS:
                found[left, kind] = sum(own) / (len(own) + 1)
        score = {(k, h): max([edges[a, kk, hh] for a, kk, hh in edges if (kk, hh) == (k, h)] + [found.get((a, kk), 0) for a, kk, hh in edges if (kk, hh) == (k, h)]) for k, h in score}
    return {p: c for p, c in found.items() if c >= private_data.SURE}


def test_discovered_identifiers_are_seeds_of_later_patterns(spark):
    rng = random.Random(12)
    mentions = [("kontakt", "phone", f"+49 170 55500{i:02d}", 1.0) for i in range(60)]
    mentions += [("kontakt", "phone", f"0170-77700{i:02d}", 0.0) for i in range(8)]
    # The second generation: never before a base entity, but before what the first one found.
    mentions += [("rufnummer", "phone", f"0170-77700{i:02d}", 0.0) for i in range(6)] + [("rufnummer", "phone", "0170-8880001", 0.0), ("rufnummer", "phone", "0170-8880002", 0.0)]
    # A third one, whose seeds are the second's; and one with too few seeds, one too vague.
    mentions += [("durchwahl", "phone", f"0170-777000{i}", 0.0) for i in range(4)] + [("durchwahl", "phone", "0170-9990001", 0.0)]
    mentions += [("zimmer", "phone", f"0170-777000{i}", 0.0) for i in range(2)] + [("zimmer", "phone", "0171-1110001", 0.0)]
    mentions += [("posten", "phone", f"0170-777000{i}", 0.0) for i in range(3)] + [("posten", "phone", f"0172-22200{i:02d}", 0.0) for i in range(9)]
    rng.shuffle(mentions)
    docs = [(i, f"so sagt man {left}: {hit} und mehr") for i, (left, _, hit, _) in enumerate(mentions)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = generations(mentions)
    assert {x[0] for x in want} == {"kontakt", "rufnummer", "durchwahl"}
    got = private_data.sure_patterns(private_data.scanned(df, "text", ["doc_id"]), df, "text").collect()
    assert {(r["left"], r["kind"]): round(r["confidence"], 9) for r in got} == {p: round(c, 9) for p, c in want.items()}
    spans = {r["doc_id"]: r["spans"] for r in private_data.find(df).collect()}
    for i, (left, _, hit, seed) in enumerate(mentions):
        at = docs[i][1].index(hit)
        assert spans[i] == (f"phone:{at}:{at + len(hit)}" if seed or (left, "phone") in want else "")


def test_words_of_any_length_are_patterns(spark):
    word = "k" + "o" * 200
    docs = [(i, f"bitte {word} +49 170 12345{i:02d} notieren") for i in range(9)] + [(50, f"bitte {word}: 0170-1234599 notieren"), (51, "bitte k" + "o" * 150 + ": 0170-1234599 notieren")]
    spans = {r["doc_id"]: r["spans"] for r in private_data.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    at = docs[9][1].index("0170")
    assert spans[50] == f"phone:{at}:{at + 12}" and spans[51] == ""


# 4: language


def test_held_out_accuracy_and_undetermined_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.select("doc_id", "lang", "text").collect()}
    judged = [(lang[r["doc_id"]][0], r["lang_pred"]) for r in rows if r["held_out"] and lang[r["doc_id"]][0] and len(brute.words(lang[r["doc_id"]][1])) >= 5 and r["lang_pred"] != "und"]
    assert len(judged) > 150 and sum(a == b for a, b in judged) / len(judged) >= 0.97
    for r in rows:
        text = lang[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1


def test_only_learning_rows_and_texts_count(spark):
    rng = random.Random(4)
    tongue = {"en": "the and of that with this from".split(), "de": "der und die nicht mit auch sich".split(), "fr": "les des que dans pour avec sur".split()}
    docs = [(i, " ".join(rng.choices(tongue[k], k=12)), k, "s") for i, k in enumerate(rng.choices(list(tongue), k=150))]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(docs + [(900, None, "en", "s"), (901, "123 --", "de", "s"), (902, "", None, None)], schema)
    model = language_id.fit(df)
    out = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert sum(out[i]["lang_pred"] == k for i, _, k, _ in docs) >= 147
    # Labels of held-out rows do not matter.
    swapped = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 else k, s) for i, t, k, s in docs]
    again = language_id.fit(spark.createDataFrame(swapped, schema))
    assert (again.weights == language_id.fit(spark.createDataFrame(docs, schema)).weights).all()


def test_the_model_does_not_depend_on_partitions_or_repeats(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(t.split(), k=9)), k) for i, (k, t) in enumerate([("aa", "ba be bi bo bu"), ("bb", "ka ke ki ko ku"), ("cc", "ma me mi mo mu")] * 80)]
    schema = "doc_id long, text string, lang string"
    monkeypatch.setattr(language_id, "SAMPLE_ALL", 60)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 1_000)
    df = spark.createDataFrame(docs, schema)
    one = language_id.fit(df.coalesce(1))
    for other in (df.repartition(7), df.unionByName(df).repartition(3)):
        assert (language_id.fit(other).weights == one.weights).all()
    # A language with few rows beside a frequent one takes part.
    learned = next(i for i in range(900, 999) if zlib.crc32(str(i).encode()) % 4 != 2)
    rare = language_id.fit(spark.createDataFrame([*docs, (learned, "zo zu za zo zu", "zz")], schema))
    assert rare.langs == ["aa", "bb", "cc", "zz"]


def test_clashing_columns_repeats_and_long_texts(spark):
    text = "the and of that with this from " * 40_000
    docs = [(1, text, "en", "a", 0.5), (1, text, "en", "a", 0.5), (2, "der die und nicht mit", "de", None, None), (None, "der die und nicht mit", None, "x", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, lang_pred string, score double")
    out = language_id.identify(df, language_id.fit(df)).collect()
    assert len(out) == 4 and sorted(r["lang_pred"] for r in out) == ["de", "de", "en", "en"] and set(df.columns) == set(out[0].asDict())


def test_no_labels_at_all(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(df, language_id.fit(df)).first()["lang_pred"] == "und"
    none = df.filter("false")
    assert language_id.identify(none, language_id.fit(none)).count() == 0


# 5: benchmark


def test_decontamination_matches_brute_force(spark, small):
    docs = docs_of(spark, small)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rng = random.Random(2)
    filler = lambda n: " ".join(f"f{rng.randint(0, 10**6)}" for _ in range(n))
    for i, (item, text) in enumerate(items[:20]):
        docs.append((50_000 + i, f"{filler(rng.randint(0, 900))} {text} {filler(400)}"))
    docs += [(60_000, None), (60_001, ""), (60_002, "one two"), (60_003, "one two"), (60_004, " ".join(t for _, t in items))]
    items += [(900, "one two"), (901, ""), (902, None), (900, "one two")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.search(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.leaks(docs, {x for x in items if x[1]})
    kept = {r["doc_id"] for r in decontamination.decontaminate(d, i).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in got}
    assert decontamination.search(d, i.filter("false")).count() == 0 and decontamination.search(d.filter("false"), i).count() == 0


def test_scattered_items_and_blocks_of_items(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"q{rng.randint(0, 10**7)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([30, 100, 404])))) for i in range(40)]
    docs = []
    for i, text in items:
        w = text.split()
        for pieces in (2, 4, max(4, len(w) // 27)):
            cuts = sorted(rng.sample(range(1, len(w)), pieces - 1))
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(w)]):
                out += w[a:b] + [word() for _ in range(rng.randint(60, 200))]
            docs.append((len(docs), " ".join(out), i))
    df = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, item_id long, containment string")
    held = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = brute.leaks([x[:2] for x in docs], items)
    assert len(want) > 60 and {(r["doc_id"], r["item_id"]) for r in decontamination.search(df, held).collect()} == want
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 15)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.search(df, held).collect()} == want
    kept = decontamination.decontaminate(df, held)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {x[0] for x in docs} - {d for d, _ in want}


# 6: near duplicates


def test_near_dedup_matches_brute_force(spark, small):
    docs = docs_of(spark, small)
    rng = random.Random(5)
    base = [f"v{rng.randint(0, 5_000)}" for _ in range(120)]
    for i in range(60):  # a family around the threshold, and a chain
        own = base[:]
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = f"u{rng.randint(0, 10**6)}"
        docs.append((20_000 + i, " ".join(own)))
    docs += [(30_000, None), (30_001, ""), (30_002, "A b"), (30_003, "a  B"), (30_004, "a b c"), (30_005, "x " * 5_000), (30_006, "x " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    want = brute.components(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len(rows) == len(docs)


def test_near_dedup_of_nothing_and_of_repeated_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert near_dedup.near_duplicates(df).count() == 0 and near_dedup.deduplicate(df).count() == 0
    rows = [(5, "a b c d e", 1), (5, "a b c d e", 2), (7, "A B C D E", 3), (8, "z", 4), (5, "other words of the same id here", 5), (None, "Other words of the same id HERE", 6)]
    rows += [(None, "lone text without any id", 7), (None, "lone text without any id", 8), (None, None, 9), (9, None, 10), (9, "z", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long")
    out = sorted(((r["doc_id"] or 99, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()), key=str)
    want = [(5, 5, True)] * 3 + [(7, 5, False), (8, 8, True), (9, 8, False), (9, 9, True), (99, 5, False), (99, None, False), (99, None, True), (99, None, True)]
    assert out == sorted(want, key=str)
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    got = {r["_key"] for r in kept.collect()}
    assert got - {1, 2, 7, 8} == {4, 5, 9, 10} and len(got & {1, 2}) == 1 and len(got & {7, 8}) == 1


def test_links_are_confirmed_on_full_sets():
    # 64-bit hashes that share their upper halves tell two sets apart.
    a = np.arange(100, dtype=np.uint64) << np.uint64(33)
    b = a + np.uint64(1)
    assert near_dedup._resemble(a, b, 80) == 0 and near_dedup._resemble(a, a, 80) == 2
    for shared in (78, 79, 80, 81, 89, 90):
        other = np.sort(np.concatenate([a[:shared], b[shared:]]))
        assert near_dedup._resemble(a, other, 80) == (2 if 100 * shared >= 80 * (200 - shared) else 0)
    big = np.arange(near_dedup.SKETCH, dtype=np.uint64)
    assert near_dedup._resemble(big, big, 80) == 1


# 7: quality


def test_quality_counts(spark, small):
    docs = docs_of(spark, small) + [(7_000, None), (7_001, ""), (7_002, "a b c d e " * 3), (7_003, "l\nl\n\n \nl"), (7_004, "é# *$ 漢<>|")]
    df = spark.createDataFrame([(*x, "en", "s") for x in docs], "doc_id long, text string, lang string, source string")
    for r in quality_rules.judge(df).collect():
        own = brute.quality(dict(docs)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == own
        assert r["base_failed"] == (own[0] < 10 or 100 * own[4] > 20 * own[0]) and not (r["kept"] and r["base_failed"])


def test_quality_fences_adapt(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("w" * n + str(rng.randint(0, 10**6)) for _ in range(40))
    rows = [(i, text(2), "en", "a") for i in range(80)] + [(100 + i, text(30), "xx", "b") for i in range(80)] + [(500, text(30), "en", "a"), (501, text(2), "xx", "b"), (502, text(2), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df.withColumn("kept", df["lang"])).collect()}
    assert not kept[500] and not kept[501] and kept[502] and all(v for k, v in kept.items() if k < 200)
    assert quality_rules.judge(df.filter("false")).count() == 0
    # The same in parts, without doc_id, and with columns that have the names of working ones.
    odd = df.select(F.col("doc_id").alias("m_word"), "text", "lang", "source", *(F.lit(7).alias(c) for c in ("_lang", "_source", "m_symbols", "m_lines_low", "_salt", "N_WORDS", "_in")))
    for rows in (-1, 10):
        out = quality_rules.judge(odd.unionByName(odd).repartition(5), broadcast_rows=rows)
        assert out.columns[:3] == ["m_word", "lang", "source"] and "N_WORDS" not in out.columns
        found = [(r["m_word"], r["kept"], r["_lang"], r["_in"], r["m_lines_low"]) for r in out.collect()]
        assert sorted(found) == sorted([(k, v, 7, 7, 7) for k, v in kept.items()] * 2)


# 10: mixing


def _same(spark, query, sql, small, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(want.columns)
    got = sorted((tuple(r[c] for c in names) for r in query(spark, small).collect()), key=str)
    assert got == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=str)


def test_quality_and_mixing_match_their_sql(spark, small):
    _same(spark, quality_rules.op7_quality_rules, quality_rules.ORACLE_SQL, small, ["documents"])
    _same(spark, mixing.op10_source_mixing, mixing.ORACLE_SQL, small, ["documents"])


@pytest.mark.parametrize("sizes", [[("a", 100), ("b", 100), ("c", 100)], [("a", 5), ("b", 1_000)], [("a", 0), ("b", 10), (None, 3)], [("a", 7)], []])
def test_targets(sizes):
    out = mixing.targets(sizes)
    total = sum(n for _, n in sizes)
    assert all(t <= 2 * n + 1e-9 for t, (_, n) in zip(out, sizes))
    assert abs(sum(out) - min(1.5 * total, 2 * total)) < 1e-6
    free = [(t, w) for (t, (_, n)), w in zip(zip(out, sizes), (5, 2, 1) * 3) if t < 2 * n - 1e-9]
    assert all(abs(t / w - free[0][0] / free[0][1]) < 1e-6 for t, w in free)


def test_mix_takes_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", None])) for i in range(400)] + [(900, None, "a"), (901, "", "zero"), (1, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for clash in ("size", "source_size", "target", "taken", "_source", "_key", "_step", "_no", "_name", "_range"):
        df = df.withColumn(clash, F.lit("x"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by.items():
        assert sum(taken) == int(target)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    assert mixing.mix(df.filter("false")).count() == 0


def test_words_are_those_of_the_contract():
    assert brute.words("a\x0bb c\x85d e") == ["a", "b c\x85d e"] and re.fullmatch(r"[^\x20\x09-\x0D]+", "b c")
