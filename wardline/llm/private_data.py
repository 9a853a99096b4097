"""Personal data: exact base patterns, and bootstrapped contextual extraction of what they miss.

Base entities are seeds. The word before a seed induces a lexical pattern; patterns and the identifier-like words they
introduce form a bipartite graph, scored in rounds: a pattern by the share of trusted instances it introduces, an
instance by its best pattern. Instances of sure patterns are seeds of the next round, so words that never stand before a
base entity can become patterns as well. Sure patterns discover identifiers of their kind that no base pattern accepts.
All of it is DataFrame operations; texts are read once, what follows works on spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, made linear: a match can only start where a run does, and runs are not given back.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word with a digit or an at sign.
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: A run of digits with inner spaces, dots, brackets and hyphens, which begins and ends as a word does.
_RUN = r"(?<![^\x20\x09-\x0D])[\p{Punct}]*[0-9][\x20().0-9-]*(?<=[0-9])(?=[\p{Punct}]*+(?:[\x20\x09-\x0D]|\z))"
#: What may stand between two digits of one number; a sentence may end between two numbers.
_BETWEEN = r"\)?(?:\x20?-\x20?|[\x20.])?\(?"
#: The longest beginning of a run that is a number of a kind.
_FITS = {k: rf"\A\(?[0-9](?:{_BETWEEN}[0-9]){{{a - 1},{b - 1}}}(?![0-9])" for k, a, b in (("card", 12, 19), ("phone", 7, 15))}
#: Rounds of scoring; each may bring patterns of one more generation.
ROUNDS = 5
#: Different seeds a pattern must introduce, and the confidence it must reach, to discover.
SEEDS, SURE = 3, 0.6
#: Share of the documents with a pattern's word in which it introduces an identifier; common words fall far below.
SPECIFIC = 0.2


_NONE = "cast(array() as array<struct<s:int,e:int,hit:string,left:string>>)"


def _left_word(before: Column) -> Column:
    """The last word before a span, lower-cased and without punctuation; empty at the start of a text."""
    spaced = F.translate(before, "\t\n\x0b\f\r", "     ")
    return F.lower(F.regexp_replace(F.substring_index(F.rtrim(spaced), " ", -1), r"[\p{Punct}]+", ""))


def spans_of(text: Column, pattern: str) -> Column:
    """Matches as array of (s, e, hit, left): code points, end exclusive; left: the word before, back to the match before."""
    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def place(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        empty = F.expr(_NONE)
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(acc: Column, q: Column) -> Column:
            s = acc["at"] + F.length(q["p"])
            e = s + F.length(q["m"])
            one = F.struct(s.alias("s"), e.alias("e"), q["m"].alias("hit"), _left_word(q["p"]).alias("left"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return let(found, place)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    return let(
        F.reverse(digits),
        lambda d: F.aggregate(
            F.sequence(F.lit(1), F.length(d)),
            F.lit(0),
            lambda a, i: a
            + let(F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)),
        )
        % 10
        == 0,
    )


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of one kind; a cheap test spares texts that cannot have any."""
    gate = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}[kind]

    def holds(hit: Column) -> Column:
        if kind == "ip":
            return hit.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")
        if kind == "card":
            return let(_digits(hit), lambda d: F.when(F.length(d) <= 19, luhn(d)).otherwise(F.lit(False)))
        if kind == "phone":
            return F.length(_digits(hit)).between(10, 15)
        return F.lit(True)

    return F.when(gate, F.filter(spans_of(text, PATTERNS[kind]), lambda x: holds(x["hit"]))).otherwise(
        F.expr(_NONE)
    )


def _kind_of(word: Column) -> Column:
    """The kind an identifier-like word could be of, or null."""
    digits = _digits(word)
    return (
        F.when(word.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]"), "email")
        .when(word.rlike(r"\A[\p{Punct}]*[0-9]{1,3}(?:[.:\[\]]{1,5}[0-9]{1,3}){3}[\p{Punct}]*\z"), "ip")
        .when(word.rlike(r"\A[\p{Punct}]*[0-9][0-9().-]*[\p{Punct}]*\z") & F.length(digits).between(12, 19), "card")
        .when(word.rlike(r"\A[\p{Punct}]*[0-9][0-9().-]*[\p{Punct}]*\z") & F.length(digits).between(7, 15), "phone")
    )


def _grouped(text: Column, based: Column) -> Column:
    """Numbers written in groups: (s, e, hit, left, kind), each up to the first base span in its run.

    Single words are left to ``_kind_of``, except that a long one may be a phone number besides a card.
    """
    none = F.expr("cast(array() as array<struct<s:int,e:int,hit:string,left:string,kind:string>>)")
    runs = F.filter(spans_of(text, _RUN), lambda r: F.length(_digits(r["hit"])) >= 7)

    def fits(r: Column) -> Column:
        cut = F.coalesce(F.array_min(F.transform(F.filter(based, lambda b: (b["s"] < r["e"]) & (b["e"] > r["s"])), lambda b: b["s"])), r["e"])
        ahead = F.length(F.regexp_extract(r["hit"], r"\A[\p{Punct}]*?(?=\([0-9]+\)|[0-9])", 0))
        own = F.substr(r["hit"], ahead + 1, F.greatest(cut - r["s"] - ahead, F.lit(0)))

        def one(kind: str, x: Column) -> Column:
            hit = F.regexp_extract(x, _FITS[kind], 0)
            return F.struct((r["s"] + ahead).alias("s"), (r["s"] + ahead + F.length(hit)).alias("e"), hit.alias("hit"), r["left"].alias("left"), F.lit(kind).alias("kind"))

        return let(own, lambda x: F.array(*(one(k, x) for k in _FITS)))

    found = F.flatten(F.transform(runs, fits))
    new = F.filter(found, lambda c: (c["hit"] != "") & (F.contains(c["hit"], F.lit(" ")) | ((c["kind"] == "phone") & (F.length(_digits(c["hit"])) >= 12))))
    return F.when(text.rlike(r"[0-9](?:[\x20().-]*+[0-9]){6}"), new).otherwise(none)


def scanned(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Written rows of ``docs``: their number, ``keep`` as one struct (no name can clash), the base spans by kind, and the
    identifier-like words beside them (cands)."""
    value = F.coalesce(docs[text], F.lit(""))
    kept = F.struct(*(docs[c] for c in keep), F.lit(0).alias("_")).alias("_in")
    based = docs.select(kept, value.alias("_text"), *(base_spans(value, k).alias(k) for k in KINDS))
    every = F.concat(*(F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS))
    words = F.when(F.col("_text").rlike("[0-9@]"), spans_of(F.col("_text"), _CANDIDATE)).otherwise(F.expr(_NONE))
    likely = F.filter(
        F.transform(
            F.filter(words, lambda w: F.length(w["hit"]) >= 7),
            lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), w["hit"].alias("hit"), w["left"].alias("left"), _kind_of(w["hit"]).alias("kind")),
        ),
        lambda w: w["kind"].isNotNull(),
    )
    cands = let(F.struct(every.alias("b"), likely.alias("w")), lambda x: F.filter(x["w"], lambda w: ~F.exists(x["b"], lambda b: (b["s"] < w["e"]) & (b["e"] > w["s"]))))
    # The span covers the word without the punctuation around it.
    trimmed = F.transform(
        cands,
        lambda w: F.struct(
            (w["s"] + F.length(F.regexp_extract(w["hit"], r"\A[\p{Punct}]*", 0))).alias("s"),
            (w["e"] - F.length(F.regexp_extract(w["hit"], r"[\p{Punct}]*\z", 0))).alias("e"),
            F.regexp_replace(w["hit"], r"\A[\p{Punct}]+|[\p{Punct}]+\z", "").alias("hit"),
            w["left"].alias("left"),
            w["kind"].alias("kind"),
        ),
    )
    grouped = let(every, lambda b: _grouped(F.col("_text"), b))
    found = based.select("_in", *KINDS, F.concat(trimmed, grouped).alias("cands"), F.monotonically_increasing_id().alias("_row"))
    return written(found, "pii-spans")


def _seeds(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["left"].alias("left"), F.lit(kind).alias("kind"), F.lower(x["hit"]).alias("hit"), F.lit(1.0).alias("seed")))


def sure_patterns(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """left, kind, confidence of the patterns that discover, from the ``scanned`` rows of ``docs``."""
    others = F.transform("cands", lambda x: F.struct(x["left"].alias("left"), x["kind"].alias("kind"), F.lower(x["hit"]).alias("hit"), F.lit(0.0).alias("seed")))
    # One edge per pattern and instance, however often they meet, with the number of rows that have it.
    edges = (
        found.select(F.explode(F.array_distinct(F.concat(*map(_seeds, KINDS), others))).alias("x")).select("x.*").filter("left != ''")
        .groupBy("left", "kind", "hit").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("rows"))
    )
    edges = written(edges, "pii-edges")
    # Only words that introduce enough different instances can become patterns, whatever the rounds bring.
    able = edges.groupBy("left", "kind").agg(F.count(F.lit(1)).alias("instances"), F.sum("rows").alias("rows")).filter(F.col("instances") >= SEEDS)
    able = written(able.select("left", "kind", "rows"), "pii-words")
    # Texts per word are summed where the texts are, before words meet patterns: a common word is one row of each task.
    # Not only the able words' texts are counted: these words grow faster than the input, and with them what would be read.
    plain = F.lower(F.regexp_replace(F.coalesce(docs[text], F.lit("")), r"[\p{Punct}]+", ""))
    each = docs.select(F.explode(F.array_distinct(F.split(plain, r"[\x20\x09-\x0D]+", -1))).alias("left"))
    counted = each.groupBy("left").agg(F.count(F.lit(1)).alias("texts"))
    special = able.join(counted, "left").filter(F.col("rows") >= SPECIFIC * F.col("texts")).select("left", "kind")
    edges = written(edges.join(special, ["left", "kind"]).select("left", "kind", "hit", "seed"), "pii-edges")
    score = edges.groupBy("kind", "hit").agg(F.max("seed").alias("score"))
    patterns = None
    for _ in range(ROUNDS):
        patterns = edges.join(score, ["kind", "hit"]).groupBy("left", "kind").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if(F.col("score") >= SURE).alias("seeds")
        )
        patterns = written(patterns.filter(F.col("seeds") >= SEEDS), "pii-patterns")
        score = (
            edges.join(patterns, ["left", "kind"], "left").groupBy("kind", "hit")
            .agg(F.greatest(F.max("seed"), F.max(F.coalesce("confidence", F.lit(0.0)))).alias("score"))
        )
    return patterns.filter(F.col("confidence") >= SURE).select("left", "kind", "confidence")


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """_row and extra, the discovered spans of a row, for rows that have some."""
    rows = found.filter(F.size("cands") > 0).select("_row", F.explode("cands").alias("c")).select("_row", "c.s", "c.e", "c.left", "c.kind")
    hits = rows.join(patterns, ["left", "kind"])
    # A number is one span: of those that begin where it does the longest, and nothing inside that.
    ordered = F.array_sort(F.collect_set(F.struct("s", (-F.col("e")).alias("e"), "kind")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,kind:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        one = F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct((-x["e"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    every = hits.groupBy("_row").agg(ordered.alias("_every"))
    return every.select("_row", F.aggregate("_every", start, step, lambda acc: acc["out"]).alias("extra"))


def _with_extra(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``found`` with extra, the discovered spans; rows without candidates are joined with nothing."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,kind:string>>)")
    extra = discovered(found, sure_patterns(found, docs, text))
    some = found.filter(F.size("cands") > 0).join(extra, "_row", "left").withColumn("extra", F.coalesce("extra", none))
    return some.unionByName(found.filter(F.size("cands") == 0).withColumn("extra", none))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), rank(x["kind"]).alias("r"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _base() -> Column:
    return F.concat(*map(_named, KINDS))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_email, n_ip, n_card, n_phone, base_sha256, and spans for every row of ``docs``.

    Null texts are empty: no spans, the digest of the empty string. Repeated rows give equal results. Base spans of
    different kinds may overlap; discovered ones overlap no base span. Texts are read whole, and words and identifiers may
    be of any length. An empty table gives an empty result.
    """
    found = _with_extra(scanned(docs, text, list(keep)), docs, text)
    return found.select(
        *(F.col(f"_in.`{c}`").alias(c) for c in keep),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(_base()), 256).alias("base_sha256"),
        _joined(F.concat(_base(), "extra")).alias("spans"),
    )


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets, other columns as they are, whatever
    their names.

    Overlapping spans are replaced as one, by the kind of the first. Null texts stay null. Rows are told apart by a number
    of their own, so null and repeated ids do not matter. An empty table gives an empty result.
    """
    found = _with_extra(scanned(docs, text, docs.columns), docs, text)
    value = F.col(f"_in.`{text}`")

    def step(acc: Column, x: Column) -> Column:
        return (
            F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substr(value, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out")))
            .otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))
        )

    def rebuilt(spans: Column) -> Column:
        whole = F.aggregate(
            spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
            lambda acc: F.concat(acc["out"], F.substr(value, acc["at"] + 1, F.length(value))),
        )
        return F.when(F.size(spans) == 0, value).otherwise(whole)

    return found.select(*(rebuilt(F.array_sort(F.concat(_base(), "extra"))).alias(c) if c == text else F.col(f"_in.`{c}`").alias(c) for c in docs.columns))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
