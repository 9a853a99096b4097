"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

Features are relative frequencies of hashed byte trigrams of the letters (lower-cased, other characters as one gap), so
a linear score is the mean of one weight per trigram and whole texts are scored in one pass. Families are given as a
parameter; languages of none of them are one more family. Only a bounded, documented sample of labelled rows is fitted
on, held as sparse counts; every row is scored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches
from .tokens import buffer_of, slices

FAMILIES = {
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
#: Labelled rows of a language the models are fitted on, at most; and over all languages (but one of each at least).
SAMPLE, SAMPLE_ALL = 400, 8_000
#: Bytes of text the sample may have; rows that do not fit are left out whole, the languages taking turns.
SAMPLE_BYTES = 32_000_000
BITS = 13
UNKNOWN = "und"


def _fold_table() -> np.ndarray:
    """Bytes of a trigram: a-z folded, bytes of other letters kept, all else a space."""
    fold = np.full(256, 32, np.uint8)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    return fold


_FOLD = _fold_table()


def _trigrams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams at all bytes of all texts (each text as if a space stood before and behind it) and the begins."""
    n = np.diff(offsets)
    # Two cells more per text: the spaces around it.
    wide = np.full(len(flat) + 2 * len(n), 32, np.uint32)
    begin = offsets + 2 * np.arange(len(n) + 1)
    put = np.arange(len(flat)) + np.repeat(2 * np.arange(len(n)) + 1, n)
    wide[put] = _FOLD[flat]
    codes = np.zeros(len(wide), np.uint32)
    if len(wide) > 2:
        codes[:-2] = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    codes *= np.uint32(0x9E3779B1)
    return codes >> np.uint32(32 - BITS), begin


class _Counts:
    """Relative frequencies of trigrams, a row per text, without their zeros."""

    def __init__(self, begin: np.ndarray, cell: np.ndarray, value: np.ndarray):
        self.begin, self.cell, self.value = begin, cell, value

    @staticmethod
    def of(texts: list[str]) -> _Counts:
        cells, values, size = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
        for t in texts:
            flat, offsets = buffer_of(pa.array([t]))
            codes, n = np.unique(_trigrams(flat, offsets)[0][: len(flat)], return_counts=True)
            cells.append(codes.astype(np.int32))
            values.append((n / max(1, len(flat))).astype(np.float32))
            size.append(len(codes))
        return _Counts(np.cumsum(size), np.concatenate(cells), np.concatenate(values))

    def rows(self, at: np.ndarray) -> _Counts:
        n = np.diff(self.begin)[at]
        begin = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(begin[-1]) + np.repeat(self.begin[:-1][at] - begin[:-1], n)
        return _Counts(begin, self.cell[take], self.value[take])

    def times(self, w: np.ndarray) -> np.ndarray:
        """One sum per text: its frequencies by their weights."""
        total = np.concatenate([[0.0], np.cumsum(self.value * w[self.cell], dtype=np.float64)])
        return total[self.begin[1:]] - total[self.begin[:-1]]

    def summed(self, v: np.ndarray) -> np.ndarray:
        """One sum per cell: the texts' frequencies by the texts' weights."""
        return np.bincount(self.cell, self.value * np.repeat(v, np.diff(self.begin)), 1 << BITS)


def _svm(x: _Counts, y: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear SVM by Pegasos with whole-set steps; classes weigh alike, features are scaled to comparable spread."""
    n = len(y)
    mean = x.summed(np.full(n, 1 / n))
    square = _Counts(x.begin, x.cell, x.value * x.value).summed(np.full(n, 1 / n))
    scale = 1 / (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-4) / np.sqrt(1 << BITS)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(1 << BITS), 0.0
    for t in range(1, rounds + 1):
        # Rows are centred and scaled here, not in memory.
        own = w * scale
        wrong = (y * (x.times(own) - mean @ own + b) < 1) * weight * y
        step = 2.0 / np.sqrt(t)
        w = w * (1 - step * decay) + step * (x.summed(wrong) - mean * wrong.sum()) * scale
        b += step * wrong.sum() * 0.1
    w = (w * scale).astype(np.float32)
    return w, float(b - mean @ w)


class Model:
    """One-versus-one SVMs between families, and between the languages of each family."""

    def __init__(self, texts: list[str], langs: list[str], families: dict[str, tuple[str, ...]]):
        x = _Counts.of(texts)
        lang = np.array(langs)
        self.langs = sorted(set(langs))
        of = {m: f for f, members in families.items() for m in members}
        self.family = {m: of.get(m, "other") for m in self.langs}
        fam = np.array([self.family[m] for m in lang]) if len(lang) else np.array([], str)
        self.families = sorted(set(self.family.values()))
        self.members = {f: [m for m in self.langs if self.family[m] == f] for f in self.families}
        self.pairs: list[tuple[str, str, str]] = []
        weights, self.bias = [], []
        for level, labels, names in [("", fam, self.families)] + [(f, lang, m) for f, m in self.members.items()]:
            for a, b in combinations(names, 2):
                rows = (labels == a) | (labels == b)
                w, bias = _svm(x.rows(np.flatnonzero(rows)), np.where(labels[rows] == a, 1.0, -1.0))
                self.pairs.append((level, a, b))
                weights.append(w)
                self.bias.append(bias)
        self.weights = np.stack(weights) if weights else np.zeros((0, 1 << BITS), np.float32)

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the name with the most won pairs (ties: the larger sum of margins) and how sure its pairs are."""
        sure = np.ones(margins.shape[1])
        if len(names) == 1:
            return np.zeros(margins.shape[1], int), sure
        score = np.zeros((len(names), margins.shape[1]))
        worst = np.full((len(names), margins.shape[1]), np.inf)
        for p, (at, a, b) in enumerate(self.pairs):
            if at == level and a in names and b in names:
                i, j, m = names.index(a), names.index(b), margins[p]
                score[i] += (m >= 0) + 0.01 * np.tanh(m)
                score[j] += (m < 0) - 0.01 * np.tanh(m)
                worst[i] = np.minimum(worst[i], m)
                worst[j] = np.minimum(worst[j], -m)
        best = score.argmax(axis=0)
        return best, 1 / (1 + np.exp(-np.clip(2 * worst[best, np.arange(len(best))], -30, 30)))

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        flat, offsets = buffer_of(column)
        n = np.diff(offsets)
        names, scores = [UNKNOWN] * len(n), np.zeros(len(n))
        # A text has letters if it has ASCII ones or, seldom looked at, others.
        ascii_letter = np.concatenate([[0], np.cumsum(_ASCII[flat])])
        ok = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
        for i in np.flatnonzero(~ok & (n > 0)):
            ok[i] = any(c.isalpha() for c in column[int(i)].as_py())
        if not self.langs or not ok.any():
            return names, scores
        codes, begin = _trigrams(flat, offsets)
        margins = np.empty((len(self.pairs), len(n)))
        for p in range(len(self.pairs)):
            total = np.concatenate([[0.0], np.cumsum(self.weights[p][codes], dtype=np.float64)])
            margins[p] = (total[begin[:-1] + n] - total[begin[:-1]]) / np.maximum(n, 1) + self.bias[p]
        family, sure = self._vote("", self.families, margins)
        for f, members in enumerate(self.members[x] for x in self.families):
            best, own = self._vote(self.families[f], members, margins)
            for i in np.flatnonzero(ok & (family == f)):
                names[i], scores[i] = members[best[i]], sure[i] * own[i]
        return names, np.clip(scores, 0, 1)


_ASCII = np.zeros(256, np.int64)
_ASCII[65:91] = _ASCII[97:123] = 1


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows of ``docs`` (doc_id, text, lang) that are not held out: up to ``sample`` of each language,
    the least by a hash of id and text, so every source and length takes part; whole texts. Equal tables give equal
    models, however they are dealt into partitions; repeated rows are taken once."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 2))
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text", F.lit("sample")).alias("hash"))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return Model([], [], families)
    each = max(1, min(sample, SAMPLE_ALL // len(counts)))
    # The rows ranked are some more than are taken, so no language's rows ever meet in one task.
    share = {r["lang"]: min(1.0, (2 * each + 20) / r["count"]) for r in counts}
    limit = F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv))[F.col("lang")]
    drawn = usable.filter(F.pmod("hash", F.lit(1_000_000)) / 1e6 < limit)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1_000_000)), "hash"))
    # The driver takes hashes and lengths of the sample first, so that its bytes are bounded before a text moves.
    sizes = drawn.select("lang", "hash", F.octet_length("text").alias("n")).distinct().withColumn("nth", nth).filter(F.col("nth") <= each).collect()
    chosen, total = set(), 0
    for r in sorted(sizes, key=lambda r: (r["nth"], r["lang"])):
        if total + r["n"] <= SAMPLE_BYTES:
            chosen.add((r["lang"], r["hash"]))
            total += r["n"]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(chosen), "lang string, hash long"))
    rows = drawn.join(wanted, ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"]).select("hash", "text", "lang").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("hash", "ascending")])
    return Model(rows["text"].to_pylist(), rows["lang"].to_pylist(), families)


def _predicting(docs: DataFrame, model: Model, schema: T.StructType, row) -> DataFrame:
    """``row(part, names, scores)`` of every part of the table, with its predictions, as one table."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield row(part, *sent.value.predict(part["text"]))

    return docs.mapInArrow(predict, schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); clashing columns are replaced.

    Only the text is an input. Null texts and texts without letters are ``und`` with score 0, as is every text when no
    labelled rows were there to fit on. Texts are read whole, however long; repeated rows get equal predictions; an empty
    table gives an empty result. Nothing is shuffled.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return _predicting(docs, model, schema, lambda part, names, scores: pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], names=schema.names))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language can be told, lang filled in where it is null; all columns stay, whatever their names."""

    def told(part, names, scores):
        pred = pa.array(names, pa.string())
        lang = pa.array([b if a is None else a for a, b in zip(part["lang"].to_pylist(), names)], pa.string())
        at = part.schema.get_field_index("lang")
        return part.set_column(at, part.schema.field(at).name, lang).filter(pc.not_equal(pred, UNKNOWN))

    return _predicting(docs, model, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]), told)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
