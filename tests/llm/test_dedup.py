"""Operators 1 and 2 against plain Python, and their parts."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from wardline.llm import anchors, windows
from wardline.llm.linear_grouping import suffix_order
from wardline.llm.substring_dedup import op1_substring_dedup, remove_repeated_words
from wardline.llm.suffix_dedup import op2_suffix_array_dedup, remove_repeated_bytes


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_order_is_the_sorted_order(symbols):
    s = [*symbols, 0]
    assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("s", [[0], [1, 0], [2, 2, 2, 2, 0], [1, 2] * 20 + [0], list(range(9, -1, -1))])
def test_suffix_order_of_special_strings(s):
    assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 62, 500, dtype=np.uint64) & ~np.uint64((1 << 24) - 1)
    grams[100:200] = grams[100]  # ties: the leftmost counts
    first = np.array([0, 3, 180, 180, 507])
    for piece in (1 << 20, 16, 100):
        monkeypatch.setattr(anchors, "PIECE", piece)
        seen = []
        for low, count, at, gram in zip(*anchors.anchor_runs(lambda a, b: grams[a:b], first, 20, 8)):
            assert gram == grams[at]
            for s in range(low, low + count):
                assert at == s + int(np.argmin(grams[s : s + 13]))
            seen += range(low, low + count)
        assert seen == [s for a, b in zip(first, first[1:]) for s in range(a, b - 19)]


def words_left(df):
    out = {}
    for r in df.collect():
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        out[r["doc_id"]] = (r["n_words"], r["n_removed"], brute.sha(r["kept"]))
    return out


def bytes_left(df):
    out = {}
    for r in df.collect():
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        out[r["doc_id"]] = (r["n_bytes"], r["n_removed"], len(r["removed"]), brute.sha(bytes(r["kept"])))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["ab", "cd", "ef", "é", "gh.", "ij,", "漢字"] + [f"w{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 45))) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(2)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(passages))
        docs.append((i * 3, rng.choice([" ", "\n", "\t ", "  "]).join(parts)))
    docs += [(1, None), (2, ""), (4, "a"), (5, " \n\t"), (7, "x " * 300), (8, "y" * 1_000), (10, passages[0]), (11, passages[0]), (13, passages[0].replace(" ", "\n"))]
    docs.append((14, " ".join(rng.choices(vocabulary, k=3_000)) + " " + passages[1]))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_word_dedup_matches_brute_force(spark, seed):
    docs = corpus(seed)
    assert words_left(remove_repeated_words(spark.createDataFrame(docs, "doc_id long, text string"))) == brute.word_dedup(docs)


@pytest.mark.parametrize("seed", [3, 4])
def test_byte_dedup_matches_brute_force(spark, seed):
    docs = corpus(seed)
    assert bytes_left(remove_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"))) == brute.byte_dedup(docs)


def test_short_windows(spark):
    docs = [(i, " ".join(random.Random(i).choices("abc", k=40))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert words_left(remove_repeated_words(df, 5)) == brute.word_dedup(docs, 5)
    assert bytes_left(remove_repeated_bytes(df, 9)) == brute.byte_dedup(docs, 9)


def test_whole_tables_match_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op1_substring_dedup(spark, small).collect()}
    assert got == brute.word_dedup(docs)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op2_suffix_array_dedup(spark, small).collect()}
    assert got == brute.byte_dedup(docs)


def test_empty_tables_extra_columns_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_words(empty).count() == 0 and remove_repeated_bytes(empty).count() == 0
    passage = " ".join(f"t{i}" for i in range(30))
    rows = [(1, passage, 5, "x"), (1, passage, 6, "y"), (None, passage, 7, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words int, chunk string")
    removed = sorted((r["doc_id"] or 99, r["n_removed"]) for r in remove_repeated_words(df).collect())
    assert len(removed) == 3 and sorted(n for _, n in removed) == [0, 30, 30] and (1, 0) in removed


def in_one_process(method, docs, n):
    """The steps of ``anchors.resolve`` without Spark: rows of all chunks."""
    tables = [pa.table({"doc_id": pa.array([d for d, _ in x], pa.int64()), "text": pa.array([t for _, t in x], pa.string())}) for x in (docs[i::n] for i in range(n))]
    own = [method.anchors(t) for t in tables]
    every, times = np.unique(np.concatenate(own), return_counts=True)
    twice = every[times > 1]
    answers, sent = [[] for _ in tables], {}
    for c, t in enumerate(tables):
        mine, of, blob = method.fragments(t, np.intersect1d(own[c], twice))
        answers[c] += [mine] if mine else []
        for b, at in anchors.by_bucket(of, n):
            sent.setdefault(b, []).append((c, blob(at)))
    for blobs in sent.values():
        for (c, _), x in zip(blobs, method.answer([b for _, b in blobs])):
            answers[c] += [x] if x else []
    return [r for t, a in zip(tables, answers) for r in method.finish(t, a).to_pylist()]


def removed_by(method, docs, n=5):
    return {r["doc_id"]: r["n_removed"] for r in in_one_process(method, docs, n)}


def want(docs, dedup):
    return {d: r[1] for d, r in dedup(docs).items()}


def test_groups_of_any_size_and_pieces_give_the_same(monkeypatch):
    docs = corpus(5)
    for capacity in (1, 7, 100):
        assert removed_by(windows.WordTrees(20, 8, capacity), docs) == want(docs, brute.word_dedup)
    monkeypatch.setattr(windows.ByteArrays, "GROUP", 1)
    monkeypatch.setattr(anchors, "PIECE", 300)
    assert removed_by(windows.ByteArrays(), docs) == want(docs, brute.byte_dedup)
    assert removed_by(windows.WordTrees(), docs) == want(docs, brute.word_dedup)


def test_prefix_groups_are_bounded_and_divide_no_prefix():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 3, 5_000)
    leaves = np.arange(4_900)
    groups = list(windows.WordTrees(20, 8, 50).prefix_groups(ids, leaves))
    assert sorted(np.concatenate(groups)) == list(range(4_900)) and max(map(len, groups)) <= 50
    of = {i: g for g, own in enumerate(groups) for i in own}
    for a in range(4_899):
        same = next(d for d in range(21) if d == 20 or ids[a + d] != ids[a + 1 + d])
        if same == 20:
            assert of[a] == of[a + 1]


def test_the_answer_comes_from_tree_and_order(monkeypatch):
    docs = corpus(6)
    words, byte = want(docs, brute.word_dedup), want(docs, brute.byte_dedup)
    assert removed_by(windows.WordTrees(), docs) == words and removed_by(windows.ByteArrays(), docs) == byte
    with monkeypatch.context() as m:
        m.setattr(windows.Subtree, "deep_nodes", lambda self, least: [])
        twins = removed_by(windows.WordTrees(), docs)
        assert twins != words
    with monkeypatch.context() as m:
        m.setattr(windows, "suffix_order", lambda s: list(range(len(s))))
        assert removed_by(windows.ByteArrays(), docs) != byte


def test_texts_in_byte_order_with_their_agreement():
    rng = random.Random(3)
    texts = list({bytes(rng.choices(b"\0a", k=rng.randint(0, 40))) for _ in range(400)} | {b"", b"\0", b"a" * 12, b"a" * 13, b"a" * 12 + b"\0"})
    heads = [rng.randrange(2) for _ in texts]
    found = windows.SuffixArray(texts, heads)
    assert found.order == sorted(range(len(texts)), key=lambda i: (heads[i], texts[i]))
    for slot in range(1, len(texts)):
        a, b = found.order[slot - 1], found.order[slot]
        same = next((i for i, (x, y) in enumerate(zip(texts[a], texts[b])) if x != y), min(len(texts[a]), len(texts[b])))
        assert found.agrees[slot] == (same if heads[a] == heads[b] else -1)


def test_a_megabyte_in_one_document():
    rng = random.Random(7)
    long = " ".join(rng.choices([f"w{i}" for i in range(5_000)], k=150_000))
    docs = [(1, long), (2, long[400_000:500_000]), (3, "x" * 300_000), (4, "ab " * 100_000)]
    assert removed_by(windows.WordTrees(), docs, 3) == want(docs, brute.word_dedup)
    assert removed_by(windows.ByteArrays(), docs, 3) == want(docs, brute.byte_dedup)


def test_hashes_of_a_bucket_meet_as_plain_sets_do():
    rng = random.Random(8)
    lists = [sorted({rng.randrange(1 << 63) if rng.random() < 0.3 else rng.randrange(40) for _ in range(rng.randrange(12))}) for _ in range(30)]
    times = Counter(h for own in lists for h in own)
    cuts = np.cumsum([0, *map(len, lists)])
    found = anchors.meet(pa.table({"chunk": range(30), "blob": anchors.cut(np.array(sum(lists, []), np.uint64), cuts)}))
    got = {c: np.frombuffer(b, np.uint64).tolist() for c, b in zip(found["chunk"].to_pylist(), found["blob"].to_pylist())}
    assert got == {c: both for c, own in enumerate(lists) if (both := [h for h in own if times[h] > 1])}


def test_a_bucket_costs_by_its_hashes_not_by_its_chunks():
    """A bucket keeps its size as the input grows, but more chunks share it: 80 at first, 2,520 at 6 GB."""
    hashes = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 160_000, dtype=np.uint64))
    hashes = np.concatenate([hashes, hashes])

    def seconds(chunks):
        cuts = np.linspace(0, len(hashes), chunks + 1).astype(np.int64)
        table = pa.table({"chunk": range(chunks), "blob": anchors.cut(hashes, cuts)})
        began = time.process_time()
        assert anchors.meet(table).num_rows == chunks
        return time.process_time() - began

    assert min(seconds(2_520) for _ in range(3)) < 3 * min(seconds(80) for _ in range(3))


def test_messages_come_back_as_they_were_sent():
    numbers = np.random.default_rng(3).integers(-(1 << 31), 1 << 31, (7, 50)).astype(np.int32)
    for some, data in ((numbers, b"abc" * 100), (numbers[:, :1], b""), (numbers[:, [4, 2]], b"\0")):
        back, text = anchors.unpack(anchors.pack(some, data))
        assert (back == some).all() and text == data


def test_many_small_chunks_and_ids_of_any_size():
    docs = [(d * (1 << 33) - (1 << 62) if d is not None else None, t) for d, t in corpus(9)]
    assert removed_by(windows.WordTrees(), docs, 60) == want(docs, brute.word_dedup)
    assert removed_by(windows.ByteArrays(), docs, 60) == want(docs, brute.byte_dedup)
