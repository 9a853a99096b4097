"""Alternative readings of a text, each gated by a cheap test, and what they bring to light."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import detect

ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
BASE64_RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
HEX_RUN = r"(?:[0-9a-fA-F]{2}){12,}"
#: Whether there is a match of either, by classes that are quick to deny.
_BASE64_HELD, _HEX_HELD = r"[\w+/-]{16}", r"\p{XDigit}{24}"
#: Escapes of string literals, a surrogate pair before its halves.
ESCAPE = (
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|(?:\\x[0-9a-fA-F]{2})+|\\U[0-9a-fA-F]{8}"
    r"|\\[0-7]{1,3}|\\[abfnrtv\\'\"\n]"
)
#: Names that count without a semicolon, the longest first.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{{1,31}};|&(?:{_BARE})"
#: What numeric references to controls mean (windows-1252, as in HTML), then the code points that stand for nothing.
_SENT = {0: "\ufffd"} | {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
_VOID = (*range(1, 9), 0xB, *range(0xE, 0x20), 0x7F, *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF)))
SUPPLEMENT = r"[\x{E0100}-\x{E01EF}]"
#: Readings that reorder the same characters: addresses in them were never encoded.
REORDERED = ("rot13", "reversed")


def base64_text(run: Column) -> Column:
    """A strict decode to readable UTF-8 of 12 bytes at least, else null. (``unbase64`` would skip invalid characters.)"""
    plain = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    padded = F.rpad(plain, ((F.length(plain) + 3) / 4).cast("int") * 4, "=")
    raw = F.when(F.length(plain) % 4 != 1, F.try_to_binary(padded, F.lit("base64")))
    return T.let(
        F.when((F.octet_length(raw) >= 12) & F.is_valid_utf8(raw.cast("string")), raw.cast("string")),
        lambda t: F.when(F.regexp_count(t, F.lit(r"[\p{Print}\p{L}\p{N}\s]")) * 10 >= F.length(t) * 9, t),
    )


def hex_text(run: Column) -> Column:
    raw = F.try_to_binary(run, F.lit("hex")).cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def wordy(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("[A-Za-z]{3,}")) >= 2) | (F.regexp_count(text, F.lit("[A-Za-z]")) >= 16)


def replaced(text: Column, pattern: str, spelt) -> Column:
    """The whole text with every match replaced by what ``spelt`` makes of it."""
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return T.let(parts, lambda x: F.array_join(F.zip_with(x["p"], F.concat(F.transform(x["m"], spelt), F.array(F.lit(""))), lambda p, m: F.concat(p, m)), ""))


def character(digits: Column, base: int) -> Column:
    """The character of a number; what is no code point gives U+FFFD."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return T.let(
        F.when(F.length(bare) <= 7, F.conv(bare, base, 10).cast("long")),
        lambda c: F.when((c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")).otherwise("\ufffd"),
    )


def utf8_or_latin(raw: Column) -> Column:
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def unescaped(text: Column) -> Column:
    """The whole text with every escape of a string literal decoded; what is malformed stays."""

    def spelt(m: Column) -> Column:
        rest = F.substr(m, F.lit(3))
        return (
            F.when(m.startswith("\\u") & (F.length(m) > 6), F.decode(F.unhex(F.replace(m, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
            .when(m.startswith("\\u") | m.startswith("\\U"), character(rest, 16))
            .when(m.startswith("\\x"), utf8_or_latin(F.unhex(F.replace(m, F.lit("\\x"), F.lit("")))))
            .when(m.rlike("[0-7]"), character(F.substr(m, F.lit(2)), 8))
            .otherwise(F.translate(F.substr(m, F.lit(2)), "abfnrtv\n", "\a\b\f\n\r\t\v"))
        )

    return replaced(text, ESCAPE, spelt)


def entities(text: Column) -> Column:
    """The whole text with every character reference decoded, numbered and named, as HTML reads them."""
    names = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in html5.items())), F.lit("\x02"), F.lit("\x01"))
    sent, void = "".join(map(chr, _SENT)), "".join(map(chr, _VOID))
    number = lambda m, at, base: F.translate(character(F.rtrim(F.substr(m, F.lit(at)), F.lit(";")), base), sent + void, "".join(_SENT.values()))

    def spelt(m: Column) -> Column:
        bare = F.regexp_extract(m, f"^&({_BARE})", 1)
        return (
            F.when(m.rlike("^&#[xX]"), number(m, 4, 16)).when(m.startswith("&#"), number(m, 3, 10))
            .otherwise(F.coalesce(F.try_element_at(names, F.substr(m, F.lit(2))), T.let(bare, lambda b: F.concat(F.try_element_at(names, b), F.substr(m, F.length(b) + 2))), m))
        )

    return replaced(text, REFERENCE, spelt)


def selected(text: Column) -> Column:
    """What the supplementary variation selectors of a text spell, one byte each."""
    byte = lambda c: F.lpad(F.hex(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long") - 0xE0100), 2, "0")
    return T.let(F.unhex(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(SUPPLEMENT), F.lit(0)), byte), "")), utf8_or_latin)


def base64_runs(text: Column) -> Column:
    """A HIGH signal for every base64 run of 24 characters or more that decodes to text with a space."""
    runs = F.when(text.rlike(_BASE64_HELD), F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    long = F.filter(runs, lambda r: F.length(F.rtrim(r, F.lit("="))) >= 24)
    return F.transform(F.filter(F.transform(long, base64_text), lambda t: F.contains(t, F.lit(" "))), lambda t: detect.signal("encoded_payload", R.HIGH, "base64", t))


def views(text: Column) -> Column:
    """Array of (label, decoded), in a fixed order; readings that do not apply are absent."""
    runs64 = F.when(text.rlike(_BASE64_HELD), F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    hexes = F.when(text.rlike(_HEX_HELD), F.regexp_extract_all(text, F.lit(HEX_RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    view = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("decoded"))
    percent = F.when(F.contains(text, F.lit("%")) & (F.regexp_count(text, F.lit("%[0-9a-fA-F]{2}")) >= 4), F.try_url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")))
    tags = F.when(~T.plain(text) & (F.regexp_count(text, F.lit(T.TAGS)) >= 4), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(T.TAGS), F.lit(0)), lambda c: F.decode(F.unhex(F.lpad(F.hex(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long") - 0xE0000), 8, "0")), "UTF-32")), ""))
    escapes = F.when(F.contains(text, F.lit("\\")) & text.rlike(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}"), unescaped(text))
    references = F.when(F.contains(text, F.lit("&#")) & text.rlike("&#[xX]?[0-9a-fA-F]{2,7};"), entities(text))
    selectors = F.when(~T.plain(text) & (F.regexp_count(text, F.lit(SUPPLEMENT)) >= 4), selected(text))
    # Settled by the first dozen letters, wherever they are; counting would read all of them.
    lettered = text.rlike("(?:[A-Za-z][^A-Za-z]*){12}")
    singles = [view("percent", percent), view("entities", references), view("escapes", escapes), view("tags", tags), view("selectors", selectors), view("rot13", F.when(lettered, F.translate(text, ROT_FROM, ROT_TO))), view("reversed", F.when(lettered, F.reverse(text)))]
    many = [
        F.transform(F.filter(F.transform(runs64, base64_text), lambda t: t.isNotNull() & wordy(t)), lambda t: view("base64", t)),
        F.transform(F.filter(F.transform(hexes, hex_text), lambda t: t.isNotNull() & wordy(t)), lambda t: view("hex", t)),
    ]
    return F.filter(F.concat(*many, F.array(*singles)), lambda v: v["decoded"].isNotNull() & (v["decoded"] != ""))


def folded(readings: Column) -> Column:
    """The readings as pieces, folded; of those equal when folded, the first. Nothing leaves the row for that."""
    each = F.transform(readings, lambda v: detect.piece("reading", v["label"], T.fold(v["decoded"]), F.lit("")))
    return T.let(each, lambda a: F.filter(a, lambda v, i: F.array_position(F.transform(a, lambda x: x["text"]), v["text"]) == i + 1))


def revealing(said: Column, aims: Column) -> Column:
    """Signals of a reading: what it shows that the canonical text (_canon) does not.

    A signal of HIGH severity makes an encoded_payload that is CRITICAL; the first link or host of a reading, whatever its
    severity, an obfuscated_destination.
    """
    # Scattered percent signs are common in links; such a link is new if its host is.
    loose = (F.col("_label") == "percent") & ~F.col("_packed")
    flat = F.regexp_replace(F.lower("_canon"), r"\P{Alnum}+", "")
    origin = lambda x: F.regexp_extract(x, "^(?:[A-Za-z]+:)?(?://)?[^/?#]+", 0)
    hidden = lambda s: ~F.contains(F.col("_canon"), F.when(loose & (s["detector"] == "url"), origin(s["excerpt"])).otherwise(s["excerpt"]))
    spread = lambda s: s["rule"].startswith("squashed_") & F.contains(flat, s["excerpt"])
    found = lambda detector, s: detect.signal(detector, R.CRITICAL, s["rule"], s["excerpt"])
    new = F.filter(aims, hidden)
    strong = F.filter(F.concat(F.filter(said, lambda s: hidden(s) & ~spread(s)), new), lambda s: s["severity"] >= R.HIGH)
    payloads = F.array_distinct(F.transform(strong, lambda s: found("encoded_payload", s)))
    links = F.slice(F.filter(new, lambda s: s["detector"].isin("url", "obfuscated_destination")), 1, 1)
    return F.concat(payloads, F.transform(links, lambda s: found("obfuscated_destination", s)))
