"""The pipeline, stage by stage, against plain Python."""

import hashlib
import math
import re

import corpus_pipeline
from tests.llm import brute
from wardline.llm import mixing


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicate removal", "benchmark decontamination", "personal data", "mixing"]


def _mixed(rows):
    """{doc_id: (size, source_size, target, taken)} of [(doc_id, text, source)]."""
    size = {d: len(brute.words(t)) for d, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(size[d] for d, _, x in rows if x == s) for s in names}
    goal = dict(zip(names, mixing.targets([(s, total[s]) for s in names])))

    def key(d, t):
        u = (int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        odd = len(re.findall(r"[#*$%&|<>!0-9_=+{}\[\]]", t or ""))
        return -math.log(u) / (max(0.25, (1 - odd / len(t)) ** 2) if t else 0.25)

    out = {}
    for s in names:
        n = total[s]
        epochs = int(goal[s] // n) if n else 0
        left = int(goal[s]) - epochs * n
        for _, d in sorted((key(d, t), d) for d, t, x in rows if x == s):
            out[d] = (size[d], n, goal[s], size[d] * epochs + max(0, min(size[d], left)))
            left -= size[d]
    return out


def test_pipeline_matches_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    extra = [(9_000, "123 456 --", "en", "web", 10), (9_001, None, None, None, None), (9_002, "the and of that is a@b.example or so it was said of the thing", "en", None, 60), (9_003, "the and of that is a@b.example or so it was said of the thing", "en", None, 60)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        path = str(tmp_path / name)
        stage(spark, now, small).write.parquet(path)
        now = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in now.collect()}
        kept[name] = set(after)
        pairs = [(d, r["text"]) for d, r in before.items()]
        if name == "language ID":
            assert set(after) == {d for d, t in pairs if any(c.isalpha() for c in t or "")}
            assert all(r["lang"] == (before[d]["lang"] or r["lang"]) and r["lang"] for d, r in after.items())
        elif name == "near-duplicate removal":
            assert set(after) == {c for _, c in brute.components(pairs, k=5).values()}
        elif name == "benchmark decontamination":
            assert set(after) == set(before) - {d for d, _ in brute.leaks(pairs, items)}
        elif name == "personal data":
            assert set(after) == set(before)
            for d, r in after.items():
                assert r["n_chars"] == len(r["text"]) and not brute.base_spans(r["text"])
                if not re.search("[0-9@]", before[d]["text"]):
                    assert r["text"] == before[d]["text"]
        else:
            want = _mixed([(d, r["text"], r["source"]) for d, r in before.items()])
            for d, r in after.items():
                assert (r["size"], r["source_size"], r["taken"]) == (want[d][0], want[d][1], want[d][3]) and abs(r["target"] - want[d][2]) < 1e-6
        if name != "mixing":
            assert now.columns == columns
            assert all(after[d][c] == before[d][c] for d in after for c in ("source",))
    assert 9_000 not in kept["language ID"] and 9_001 not in kept["language ID"]
    assert 9_002 in kept["personal data"] and 9_003 not in kept["personal data"]


def test_stages_take_empty_tables(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0


def test_stages_keep_columns_of_any_name(spark, small):
    names = ["_kept", "_key", "_k", "_id", "_in", "_row", "lang_pred", "score", "component", "rep", "extra", "email", "item_id", "hash"]
    texts = ["the and of that with this from one", "the and of that with this from one", "der die und nicht mit auch sich", None, "write to a@b.example and the others of that", "the " * 30_000, ""]
    rows = [(i if i != 2 else None, t, "en" if i % 2 else None, None, i, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        found = out.collect()
        kept[name] = {int(r["_kept"][5:]) for r in found}
        assert all(r[n] == f"{n}{r['_kept'][5:]}" for r in found for n in names), name
    assert kept["language ID"] == {0, 1, 2, 4, 5} and kept["near-duplicate removal"] == {0, 2, 3, 4, 5, 6} and kept["benchmark decontamination"] == kept["personal data"] == set(range(7))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 7


def test_query_is_the_chain(spark, small):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, small)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() > 0
