"""Detectors as Column expressions: each gives an array of signals (detector, severity, rule, excerpt)."""

from __future__ import annotations

from collections.abc import Container, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import needs as N

SIGNAL = "struct<detector:string,severity:int,rule:string,excerpt:string>"
NONE = f"cast(array() as array<{SIGNAL}>)"


def signal(detector: str, severity: Column | int, rule: str | Column, excerpt: Column, width: int = 90) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    name = rule if isinstance(rule, Column) else F.lit(rule)
    return F.struct(F.lit(detector).alias("detector"), level.cast("int").alias("severity"), name.alias("rule"), T.clip(excerpt, width).alias("excerpt"))


def _kept(items: Iterable[Column]) -> Column:
    items = list(items)
    return F.array_compact(F.array(*items)) if items else F.expr(NONE)


#: The expressions whose words ``noted`` notes.
_NOTED = (
    *(r.regex for r in (*R.PHRASES, *R.DIRECTION, *R.DEPRECATED, *R.GATE)), R.VERB_NAME, R.NAME_MODAL, R.CORE_VERB, R.SECRET, R.RECIPIENT,
)


def noted(canon: Column) -> Column:
    """What a text has of the words that expressions need; the detectors below take it, so that a text is searched once."""
    return F.expr(N.noted(T.sql_of(canon), N.beginnings(_NOTED)))


def _noting(canon: Column, rules: Iterable[R.Rule], hits: Column | None, body: str) -> Column:
    """``body``, SQL in which ``h`` is what was noted of a text for the rules."""
    of = N.noted(T.sql_of(canon), N.beginnings(r.regex for r in rules)) if hits is None else T.sql_of(hits)
    return F.expr(f"transform(array({of}), h -> {body})[0]")


def _hit_sql(canon: str, low: str, rule: R.Rule) -> str:
    """Whether a rule matches: words that the expression needs (``h``), one of its gate's as a plain substring, then the
    expression."""
    gate = " OR ".join(f"contains({low}, {T.literal(w)})" for w in rule.gate)
    return f"(({N.told(rule.regex, 'h', low) or 'true'}) AND ({gate}) AND rlike({canon}, {T.literal(rule.regex)}))"


def rule_hit(canon: Column, low: Column, rule: R.Rule, hits: Column | None = None) -> Column:
    return _noting(canon, [rule], hits, _hit_sql(T.sql_of(canon), T.sql_of(low), rule))


def _signal_sql(detector: str, severity: int | str, rule: str, excerpt: str) -> str:
    return f"named_struct('detector', '{detector}', 'severity', {severity}, 'rule', {rule}, 'excerpt', {T.clip_sql(excerpt)})"


def _cases(canon: Column, low: Column, rules: Iterable[R.Rule]) -> list[str]:
    c, l = T.sql_of(canon), T.sql_of(low)  # noqa: E741
    return [f"WHEN {_hit_sql(c, l, r)} THEN {_signal_sql(r.detector, r.severity, T.literal(r.id), f'regexp_extract({c}, {T.literal(r.regex)}, 0)')}" for r in rules]


def by_pattern(canon: Column, low: Column, rules: Iterable[R.Rule], hits: Column | None = None) -> Column:
    """One signal per rule that matches."""
    return _noting(canon, rules, hits, f"array_compact(array({', '.join(f'CASE {x} END' for x in _cases(canon, low, rules))}))")


def call_direction(canon: Column, low: Column, hits: Column | None = None) -> Column:
    """One signal, of the match that begins first (of several, the rule that comes first in the table): LOW if the text
    goes on with this or it, else MEDIUM."""
    c, l = T.sql_of(canon), T.sql_of(low)  # noqa: E741

    def first(r: R.Rule) -> str:
        p = T.literal(r.regex)
        about = f"coalesce(rlike(element_at(split({c}, {p}, 2), 2), {T.literal(_OWN)}), false)"
        return f"CASE WHEN {_hit_sql(c, l, r)} THEN named_struct('at', length(split({c}, {p}, 2)[0]), 'rule', {T.literal(r.id)}, 'hit', regexp_extract({c}, {p}, 0), 'own', {about}) END"

    earliest = let_least(_noting(canon, R.DIRECTION, hits, f"array_compact(array({', '.join(map(first, R.DIRECTION))}))"))
    return F.transform(earliest, lambda x: signal("call_direction", F.when(x["own"], R.LOW).otherwise(R.MEDIUM), x["rule"], x["hit"]))


_OWN = r"\A[ \t\r\n]*(?:this|it)(?:[^A-Za-z0-9_]|\z)"


def let_least(found: Column) -> Column:
    """Of structs that begin with ``at``, an array of the first with the least one, or of none."""
    return T.let(found, lambda a: F.slice(F.filter(a, lambda x: x["at"] == F.array_min(F.transform(a, lambda y: y["at"]))), 1, 1))


def once(canon: Column, low: Column, rules: Iterable[R.Rule], hits: Column | None = None) -> Column:
    """One signal at most, of the first rule in the table that matches."""
    return _noting(canon, rules, hits, f"array_compact(array(CASE {' '.join(_cases(canon, low, rules))} END))")


def deprecation(canon: Column, low: Column, hits: Column | None = None) -> Column:
    """A text that declares itself deprecated and names a replacement: HIGH if it binds all calls, else a notice."""
    declared = rule_hit(canon, low, R.DEPRECATED[0], hits)
    names = F.filter(F.regexp_extract_all(canon, F.lit(R.REPLACEMENT), F.lit(1)), lambda n: ~n.rlike(R.PARAMETER_TAIL) & ~n.rlike(R.VERSION))
    first = F.get(names, 0)
    redirect = signal("deprecation_redirect", R.HIGH, "deprecation_redirect", first)
    notice = signal("deprecation_notice", R.MEDIUM, "deprecation_notice", first)
    return _kept([F.when(declared & first.isNotNull(), F.when(canon.rlike(R.UNIVERSAL), redirect).otherwise(notice))])


def _found(text: Column, pattern: str, gate: Column, group: int = 0) -> Column:
    """All matches, or none where the gate says that there cannot be any."""
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _told(low: Column, hits: Column, pattern: str) -> Column:
    """Whether a text can match, by what was noted of it."""
    return F.expr(N.told(pattern, T.sql_of(hits), T.sql_of(low)))


def foreign_actions(canon: Column, low: Column | None = None, hits: Column | None = None) -> Column:
    """Every other action that is named: called, routed through, or dangerous by its name."""
    joined = F.contains(canon, F.lit("_"))

    def each(pattern: str, make) -> Column:
        gate = T.has_any(F.lower(canon), R.NEEDS_ACTION) if hits is None else _told(low, hits, pattern)
        return F.transform(_found(canon, pattern, gate, 1), make)

    danger = lambda n: n.rlike(R.DANGEROUS)
    called = [each(p, lambda n: signal("foreign_action", F.when(danger(n), R.CRITICAL).otherwise(R.HIGH), "called", n)) for p in (R.VERB_NAME, R.NAME_MODAL)]
    routed = F.transform(
        F.filter(_found(canon, R.ROUTED, joined, 1), lambda n: ~n.rlike(R.PARAMETER_TAIL)),
        lambda n: F.when(danger(n), signal("foreign_action", R.CRITICAL, "routed", n)).otherwise(signal("action_like_name", R.MEDIUM, "routed", n)),
    )
    named = F.transform(
        _matches(canon, R.DANGEROUS, joined),
        lambda x: F.when(
            F.concat(T.run_up(canon, x["s"], 120), F.lit(" "), F.substr(canon, x["e"] + 1, F.lit(120))).rlike(R.DIRECTIVE),
            signal("foreign_action", R.CRITICAL, "dangerous", x["hit"]),
        ).otherwise(signal("action_like_name", R.MEDIUM, "dangerous", x["hit"])),
    )
    return F.concat(*called, routed, named)


def squashed(canon: Column) -> Column:
    """For decoded text: a marker that shows once everything but letters and digits is gone."""
    flat = F.regexp_replace(F.lower(canon), r"\P{Alnum}+", "")

    def first(f: Column) -> Column:
        cases = None
        for m in R.SQUASHED:
            found = signal("instruction_override", R.CRITICAL, F.lit(f"squashed_{m}"), F.lit(m))
            # A long literal as an expression skips over the text, which a search for a substring does not.
            cases = F.when(f.rlike(m), found) if cases is None else cases.when(f.rlike(m), found)
        return _kept([cases])

    return T.let(flat, first)


def phrases(canon: Column, low: Column, hits: Column) -> Column:
    """All of the above; ``hits`` is what was ``noted``."""
    return F.concat(
        by_pattern(canon, low, R.PHRASES, hits), call_direction(canon, low, hits), deprecation(canon, low, hits), foreign_actions(canon, low, hits), once(canon, low, R.GATE, hits)
    )


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    return F.when(gate, T.spans(text, pattern)).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,hit:string>>)"))


def rate(text: Column, start: Column, verb: Column, secret: Column) -> Column:
    """Severity of a destination from what stands before it and what the text speaks of."""
    run = T.run_up(text, start, 30)
    directed = run.rlike(R.DIRECTED)
    weak = T.run_up(text, start, 60).rlike(R.WEAK_VERB)
    active = verb | weak
    return (
        F.when(run.rlike(R.DOCUMENTED) & ~directed, R.MEDIUM)
        .when(active & secret & directed, R.CRITICAL)
        .when(active, R.HIGH)
        .otherwise(R.MEDIUM)
    )


def destinations(df: DataFrame, canon: str = "canon", out: str = "destinations", width: int = 90, only: Container[str] | None = None) -> DataFrame:
    """Adds the destination signals. Order matters: each step leaves out what overlaps the spans of earlier ones.

    Excerpts of links and hosts are cut at ``width``. Where ``only`` some rules are asked for, their signals are all there is,
    and of the steps are left those that they rest on.
    """
    t, low = F.col(canon), F.col("_lower")
    df = df.withColumn("_lower", F.lower(t))
    hits = F.col("_words")
    df = df.withColumn("_words", noted(t))
    has = lambda x: F.contains(t, F.lit(x))
    slash = has("//")
    df = df.withColumns(
        {
            "_verb": _told(low, hits, R.CORE_VERB) & t.rlike(R.CORE_VERB),
            "_secret": _told(low, hits, R.SECRET) & t.rlike(R.SECRET),
            "_long": t.rlike(r"\p{Alnum}{26}"),
            "_mail": _matches(t, R.EMAIL, F.contains(t, F.lit("@"))),
            "_image": _matches(t, R.IMAGE, F.contains(t, F.lit("!["))),
            "_link": _matches(t, R.LINK, F.contains(t, F.lit("]("))),
            "_url": _matches(t, R.URL, slash),
        }
    )
    df = df.withColumn("_s4", F.filter("_url", lambda u: ~T.overlaps(u, F.col("_image"))))
    df = df.withColumn("_seen", F.concat(*(F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for c in ("_image", "_url", "_mail"))))

    def step(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
        free = F.filter(_matches(t, pattern, gate), lambda x: ~T.overlaps(x, F.col("_seen")))
        df = df.withColumn(name, free)
        return df.withColumn("_seen", F.concat("_seen", F.transform(name, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    df = step(df, "_s5", R.RELATIVE, slash)
    df = step(df, "_s6", R.ADDRESS_PORT, t.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]"))
    df = step(df, "_s7", R.SCHEMES, has(":") & (has("://") | F.contains(low, F.lit("data:")) | F.contains(low, F.lit("mailto:"))))
    df = step(df, "_s8", R.HOST, has(".") & t.rlike(rf"(?i)\.(?:{R.TLDS})"))
    v, k = F.col("_verb"), F.col("_secret")
    at = lambda x: rate(t, x["s"], v, k)
    high = lambda x: F.greatest(at(x), F.lit(R.HIGH))
    public = lambda x: ~x["hit"].rlike(R.PRIVATE)
    aimed = lambda x: T.run_up(t, x["s"], 60).rlike(R.DIRECTED) | T.run_up(t, x["s"], 60).rlike(R"(?i)(?:recipient|destination|payee|beneficiary|receiver)")
    label = lambda x: F.regexp_extract(x["hit"], r"^\[([^\]]*)\]", 1)
    host = lambda x: F.lower(F.regexp_extract(label(x), R.HOST, 0))
    target = lambda x: F.lower(F.regexp_extract(x["hit"], r"\]\(([^)]*)\)", 1))
    every = {
        "image": lambda: F.transform("_image", lambda x: signal("markdown_image", R.HIGH, "image", x["hit"], width)),
        "link": lambda: F.transform(F.filter("_link", lambda x: (host(x) != "") & ~F.contains(target(x), host(x))), lambda x: signal("link_text_mismatch", R.CRITICAL, "link", x["hit"], width)),
        **{f"form_{n}": lambda n=n, p=p: _obfuscated(t, low, n, p) for n, p in enumerate(R.OBFUSCATED)},
        "url": lambda: F.transform("_s4", lambda x: signal("url", at(x), "url", x["hit"], width)),
        "relative": lambda: F.transform("_s5", lambda x: signal("url", high(x), "relative", x["hit"], width)),
        "address": lambda: F.transform(F.filter("_s6", lambda x: x["hit"].rlike("[:/]")), lambda x: signal("url", F.when(public(x), high(x)).otherwise(at(x)), "address", x["hit"], width)),
        "scheme": lambda: F.transform("_s7", lambda x: signal("url", at(x), "scheme", x["hit"], width)),
        "host": lambda: F.transform("_s8", lambda x: signal("url", at(x), "host", x["hit"], width)),
        "recipient": lambda: F.transform(_found(t, R.RECIPIENT, _told(low, hits, R.RECIPIENT)), lambda x: signal("url", R.MEDIUM, "recipient", x, width)),
        "collector": lambda: F.transform(_found(t, R.COLLECTOR, T.has_any(low, R.NEEDS_COLLECTOR)), lambda x: signal("url", R.HIGH, "collector", x, width)),
        **{name: lambda name=name, p=p: _addresses(t, name, p, aimed, v) for name, p in R.CHAIN},
        "email": lambda: F.transform(
            F.filter("_mail", lambda x: v | T.run_up(t, x["s"], 60).rlike(R.WEAK_VERB)),
            lambda x: signal("email_destination", F.when(x["hit"].rlike(R.ROLE_MAILBOX), R.MEDIUM).otherwise(R.HIGH), "email", x["hit"]),
        ),
    }
    parts = [make() for rule, make in every.items() if only is None or rule in only]
    df = df.withColumn(out, F.concat(*parts))
    return df.drop("_lower", "_words", "_verb", "_secret", "_long", "_mail", "_image", "_link", "_url", "_s4", "_seen", "_s5", "_s6", "_s7", "_s8")


def _obfuscated(t: Column, low: Column, n: int, pattern: str) -> Column:
    return F.transform(_found(t, pattern, T.has_any(low, R.NEEDS_OBFUSCATED[n])), lambda x: signal("obfuscated_destination", R.CRITICAL, f"form_{n}", x))


def _addresses(t: Column, name: str, pattern: str, aimed, verb: Column) -> Column:
    whole = rf"(?:^|[^A-Za-z0-9]){pattern}(?:[^A-Za-z0-9]|$)"
    gate = F.col("_long")
    if name == "base58":
        gate = gate & (verb | t.rlike("(?i)address"))
    return F.transform(_matches(t, whole, gate), lambda x: signal("hardcoded_address", F.when(aimed(x), R.HIGH).otherwise(R.LOW), name, F.regexp_extract(x["hit"], pattern, 0)))


#: Joins emoji, and marks ordinary in right-to-left text.
_MILD = "\u200d" + T.WEAK_MARKS


def characters(text: Column) -> Column:
    """Signals of the raw text: invisible, directional, tag and selector characters, and the first word of mixed scripts.

    Invisible characters and format controls are counted by name, in the order in which the text has them: an invisible
    one is CRITICAL if it sits inside a word of ASCII letters somewhere, MEDIUM if it has an ordinary use, else HIGH.
    """
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    count = lambda p: F.regexp_count(text, F.lit(p))
    inside = F.regexp_extract_all(text, F.lit(rf"(?<=[A-Za-z])[{T.ZERO_WIDTH}&&[^\xAD]](?=[A-Za-z])"), F.lit(0))
    mild = F.array(*map(F.lit, _MILD))
    named = lambda n, c: F.concat(n.cast("string"), F.lit(" x U+"), F.lpad(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+", ""), 4, "0"))
    times = lambda a, c: F.size(F.filter(a, lambda x: x == c))
    zero = T.let(
        F.struct(every(f"[{T.ZERO_WIDTH}]").alias("all"), inside.alias("inside")),
        lambda z: F.transform(
            F.array_distinct(z["all"]),
            lambda c: signal(
                "zero_width", F.when(F.array_contains(z["inside"], c), R.CRITICAL).when(F.array_contains(mild, c), R.MEDIUM).otherwise(R.HIGH), "zero_width", named(times(z["all"], c), c)
            ),
        ),
    )
    other = T.let(
        every(rf"[\p{{Cf}}&&[^{T.ZERO_WIDTH}{T.BIDI}\x{{E0000}}-\x{{E007F}}]]"),
        lambda a: F.transform(F.array_distinct(a), lambda c: signal("format_control", R.HIGH, "format", named(times(a, c), c))),
    )
    word = F.regexp_extract(text, rf"((?:[A-Za-zÀ-ɏ]+[{T.FOREIGN}]|[{T.FOREIGN}]+[A-Za-zÀ-ɏ])[A-Za-zÀ-ɏ{T.FOREIGN}]*)", 1)
    bidi, tags = count(f"[{T.BIDI}]"), count(T.TAGS)
    selectors = F.regexp_count(text, F.lit(r"[\x{E0100}-\x{E01EF}]")) + F.regexp_count(text, F.lit(r"(?<=[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}])[\x{FE00}-\x{FE0F}]"))
    many = lambda n, s: F.array_repeat(s, n.cast("int"))
    odd = text.rlike(rf"[{T.ZERO_WIDTH}{T.BIDI}{T.FOREIGN}\p{{Cf}}\x{{E0000}}-\x{{E007F}}\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}]")
    found = F.concat(
        many(selectors, signal("variation_selector", R.CRITICAL, "selector", F.lit("selector"))),
        many(bidi, signal("bidi_control", R.CRITICAL, "bidi", F.lit("direction control"))),
        many(tags, signal("tag_characters", R.CRITICAL, "tag", F.lit("tag character"))),
        zero,
        other,
        _kept([F.when(word != "", signal("mixed_script", F.when(word.rlike(f"[{T.LOOKALIKE_FROM}]"), R.CRITICAL).otherwise(R.HIGH), "mixed", word))]),
    )
    return F.when(T.plain(text) | ~odd, F.expr(NONE)).otherwise(found)


def disguised(text: Column) -> Column:
    """A signal if three letters or more are written in another alphabet that normalisation takes for ASCII."""
    return T.let(T.disguised_letters(text), lambda n: _kept([F.when(n >= 3, signal("disguised_text", R.HIGH, "nfkc", F.concat(n.cast("string"), F.lit(" letters"))))]))


def layout(text: Column) -> Column:
    return _kept(
        [
            F.when(text.rlike(R.HEX_BLOB_HELD), signal("hex_blob", R.MEDIUM, "hex_blob", F.regexp_extract(text, R.HEX_BLOB, 0))),
            F.when(text.rlike(R.BURIED), signal("buried_content", R.MEDIUM, "blank_lines", F.lit("text after blank lines"))),
            F.when(text.rlike(R.PADDED), signal("buried_content", R.MEDIUM, "padding", F.lit("text after padding"))),
            F.when(F.length(text) > R.OVERSIZED, signal("oversized", R.LOW, "oversized", F.length(text).cast("string"))),
        ]
    )


PIECE = "struct<kind:string,label:string,text:string,shown:string>"


def piece(kind: str, label: Column | str, text: Column, shown: Column) -> Column:
    """A text that is read along with the one that holds it: what it is, and what of it is shown."""
    name = label if isinstance(label, Column) else F.lit(label)
    return F.struct(F.lit(kind).alias("kind"), name.alias("label"), text.alias("text"), shown.alias("shown"))


def hidden_markup(text: Column) -> Column:
    """Every hidden element as a piece: its kind, and what it holds."""

    def each(name: str, pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: piece("markup", name, T.fold(x), x))
        return F.when(F.contains(text, F.lit(R.MARKUP_SIGNS[name])) & text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{PIECE}>)"))

    return F.concat(*(each(n, p) for n, p in R.MARKUP))


def escape_run(text: Column) -> Column:
    """The first run of the first of the five escape forms as a piece: its form, and what it spells (empty if nothing)."""
    cases = None
    for n, p in enumerate(R.ESCAPES):
        run = F.regexp_extract(text, p, 0)
        found = piece("escape", f"form_{n}", F.coalesce(decoded_escape(run, n), F.lit("")), run)
        hit = F.contains(text, F.lit(R.ESCAPE_SIGNS[n])) & text.rlike(p)
        cases = F.when(hit, found) if cases is None else cases.when(hit, found)
    return F.array_compact(F.array(cases))


def decoded_escape(run: Column, form: int) -> Column:
    """What a run of escapes spells; null if it cannot be decoded."""
    point = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    if form == 0:
        return F.array_join(F.transform(F.regexp_extract_all(run, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1)), point), "")
    if form == 1:
        return _valid(F.try_to_binary(F.regexp_replace(run, r"\\x", ""), F.lit("hex")).cast("string"))
    if form == 2:
        return F.array_join(F.transform(F.regexp_extract_all(run, F.lit("&#([0-9]{2,7});"), F.lit(1)), lambda d: point(F.hex(F.least(d.cast("long"), F.lit(0x10FFFF))))), "")
    if form == 3:
        return F.array_join(F.transform(F.regexp_extract_all(run, F.lit("(?i)&#x([0-9a-f]{2,6});"), F.lit(1)), point), "")
    return _valid(F.try_to_binary(F.regexp_replace(run, "%", ""), F.lit("hex")).cast("string"))


def _valid(text: Column) -> Column:
    return F.when(F.is_valid_utf8(text), text)
