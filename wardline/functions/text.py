"""Text canonicalisation, match spans, and character classes as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The code points that Unicode defines without a visible mark, by their name. Written as numbers, so that
#: no invisible character stands in this file.
_ZERO = (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2028, 0x2029, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFEFF, 0xFFA0)
ZERO_WIDTH = "".join(map(chr, _ZERO))
#: Marks and controls of direction, tag characters, and variation selectors, as Unicode has them.
WEAK_MARKS = "\u200e\u200f\u061c"
BIDI = "".join(map(chr, (*range(0x202A, 0x202F), *range(0x2066, 0x206A))))
TAGS = r"[\x{E0000}-\x{E007F}]"
SELECTORS = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
STRIPPED = rf"[{ZERO_WIDTH}{BIDI}\x{{E0000}}-\x{{E007F}}\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}\p{{Cf}}]"

#: Letters that look like Latin ones, by script, each beside the letter it is read as. They must be these
#: for texts to be read alike; accented Latin letters are not among them.
_PAIRS = """
Cyrillic аa вb сc ԁd еe ёe єe нh һh іi їi јj кk мm оo рp ԛq ѕs тt ѵv ԝw ѡw хx уy
Cyrillic АA ВB СC ЕE ЁE НH ІI ЈJ КK МM ОO РP ԚQ ЅS ТT ѴV ԜW ХX УY
Greek αa βb ϲc εe ϵe ιi ϳj κk ηn οo ρp ϱp τt υu μu νv ωw χx γy
Greek ΑA ΒB ΕE ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΧX ΥY ΖZ
Armenian աa եe ցg հh յj ոn օo քp գq րr սu
Cherokee ᎪA ᏴB ᏟC ᎠD ᎬE ᎦF ᏀG ᎻH ᎫJ ᏦK ᏞL ᏓZ ᎷM ᏢP ᎡR ᏚS ᏖT ᎢT ᏙV ᏔW ᎳW ᏃZ
Coptic ⲁa ⲥc ⲉe ⲏh ⲓi ⲕk ⲙm ⲛn ⲟo ⲣp ⲧt ⲭx
Lisu ꓮA ꓐB ꓚC ꓓD ꓱE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓘK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ
Syllabics ᗅA ᗷB ᑕC ᗞD ᗪD ᕮE ᖴF ᕼH ᒪL ᗰM ᘉN ᑎN ᑭP ᖇR ᖶT ᑌU ᗯW ᖯb
Latin ɑa ᴀa ᴄc ᴅd ᴇe ɡg ɢg ʜh ıi ɪi ᴊj ᴋk ʟl ℓl ⅼl ᴍm ɴn ᴏo ᴘp ʀr ſs ꜱs ᴛt ᴜu ᴠv ᴡw ʏy ᴢz
"""
_LOOKALIKES = {pair[0]: pair[1] for line in _PAIRS.split("\n") for pair in line.split()[1:]}
LOOKALIKE_FROM, LOOKALIKE_TO = "".join(_LOOKALIKES), "".join(_LOOKALIKES.values())
#: Scripts whose letters are not expected inside a Latin word: Greek, Cyrillic, Armenian, Hebrew, Arabic, Georgian,
#: Cherokee and its supplement, syllabics, Coptic, Lisu, and Deseret.
FOREIGN = r"\x{370}-\x{3FF}\x{400}-\x{52F}\x{530}-\x{58F}\x{590}-\x{5FF}\x{600}-\x{6FF}\x{10A0}-\x{10FF}\x{13A0}-\x{13FF}\x{AB70}-\x{ABBF}\x{1400}-\x{167F}\x{2C80}-\x{2CFF}\x{A4D0}-\x{A4FF}\x{10400}-\x{1044F}"


@cache
def unstable() -> str:
    """The characters that compatibility normalisation changes or may combine with what stands before them. Texts without
    any of them are their own normal form."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF}
    joins = {x for c in forms for x in unicodedata.normalize("NFD", c)[1:]}
    return "".join(c for c, f in forms.items() if f != c or c in joins or unicodedata.combining(c))


@cache
def disguises() -> str:
    """The letters beyond ASCII whose compatibility form is ASCII letters."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x30000) if chr(c).isalpha())
    return "".join(c for c, f in forms if f.isascii() and f.isalpha())


def beyond(text: Column) -> Column:
    """What a text has beyond ASCII and the accented letters of Latin-1."""
    return F.regexp_replace(text, r"[\x00-\x7F\xC0-\xFF]+", "")


def among(text: Column, characters: str) -> Column:
    """How many characters of a text are among others: a lookup for each, however many there are."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def plain(text: Column) -> Column:
    """Whether a text is ASCII: as many bytes as code points. Most character work can be left out then."""
    return F.octet_length(text) == F.length(text)


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in a text; plain substrings cost far less than an expression."""
    found = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(low, F.lit(w))
    return found


def fold(text: Column) -> Column:
    """Invisible characters removed and look-alike letters replaced: the part of canonicalisation that needs no Python."""
    whole = F.coalesce(text, F.lit(""))
    # What is removed or replaced lies beyond ASCII and Latin-1's letters; few texts have any of it.
    return F.when(plain(whole), whole).when(beyond(whole) == "", whole).otherwise(F.translate(F.regexp_replace(whole, STRIPPED, ""), LOOKALIKE_FROM, LOOKALIKE_TO))


@cache
def _dropped() -> re.Pattern:
    """The characters without a visible mark: those named above, format controls, selectors and tags."""
    points = {*map(ord, ZERO_WIDTH + BIDI), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE01F0), *(c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")}
    return re.compile(f"[{''.join(map(re.escape, map(chr, sorted(points))))}]+")


_ALIKE = re.compile(f"[{LOOKALIKE_FROM}]")


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return text
    whole = unicodedata.normalize("NFKC", _dropped().sub("", text))
    return whole if whole.isascii() else _ALIKE.sub(lambda m: _LOOKALIKES[m[0]], whole)


@F.pandas_udf(StringType())
def canonicalised(text: pd.Series) -> pd.Series:
    """The full form, with compatibility normalisation, which Spark has no function for. Nulls stay null.

    Texts go through one by one: put into a series at once, a list becomes an array in which each takes as much room as
    the longest.
    """
    return text.map(canonical, na_action="ignore")


def disguised_letters(text: Column) -> Column:
    """Non-ASCII letters whose compatibility form is ASCII letters."""
    return F.when(plain(text), F.lit(0)).otherwise(let(beyond(text), lambda t: among(t, disguises())))


#: What normalisation looks at together: characters beyond ASCII, and the one before them that they may join. Nothing joins
#: ASCII to what stands before it, and no mark joins a control.
_RUN = r"[\x20-\x7E]?+[^\x00-\x7F]+"


def with_canonical(df: DataFrame, text: str, out: str = "canon") -> DataFrame:
    """Adds the canonical text. Python sees only texts with something that normalisation changes, and of these only the
    runs beyond ASCII, in lines; of others it gets a null, and they are folded where they are."""
    whole = F.coalesce(F.col(text), F.lit(""))
    runs = F.array_join(F.regexp_extract_all(whole, F.lit(_RUN), F.lit(0)), "\n")
    odd = df.withColumn("_odd", F.when(~plain(whole) & let(beyond(whole), lambda t: among(t, unstable()) > 0), runs))
    parts = F.struct(F.split(whole, _RUN, -1).alias("p"), F.split("_odd", "\n", -1).alias("m"))
    woven = let(parts, lambda x: F.array_join(F.zip_with(x["p"], F.concat(x["m"], F.array(F.lit(""))), lambda p, m: F.concat(p, m)), ""))
    return odd.withColumn("_odd", canonicalised("_odd")).withColumn(out, F.when(F.col("_odd").isNotNull(), woven).otherwise(fold(whole))).drop("_odd")


def sql_of(column: Column) -> str:
    """The SQL of a column, for expressions that are written as one string: a rule table of hundreds of nodes then takes
    one call to the JVM, not one for each node."""
    return str(column)[len("Column<'") : -len("'>")]


def literal(text: str) -> str:
    """A Spark SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escaped(character: str) -> str:
    """A character as it stands in an expression, inside a class or not."""
    return character if character.isalnum() or not character.isascii() or character == " " else "\\" + character


def clip_sql(text: str, n: int = 90) -> str:
    """``clip`` as SQL."""
    return f"transform(array(trim(regexp_replace({text}, '[ \\\\t\\\\r\\\\n\\\\f\\\\x0b]+', ' '))), f -> CASE WHEN length(f) > {n} THEN concat(left(f, {n - 1}), '…') ELSE f END)[0]"


def clip(text: Column, n: int = 90) -> Column:
    """White space collapsed, cut at ``n`` with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n - 1)), F.lit("…"))).otherwise(flat)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str) -> Column:
    """All matches as array of (s, e, hit): code points from 0, end exclusive.

    ``split`` gives what lies between matches, so offsets are sums of lengths; they count code points, unlike
    ``regexp_instr``.
    """
    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def place(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        empty = F.expr("cast(array() as array<struct<s:int,e:int,hit:string>>)")

        def step(acc: Column, q: Column) -> Column:
            s = acc["at"] + F.length(q["p"])
            e = s + F.length(q["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), q["m"].alias("hit")))).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    return let(found, place)


def run_up(text: Column, start: Column, n: int) -> Column:
    """Up to ``n`` code points before a 0-based ``start``; a negative position would count from the end, so it is clamped."""
    low = F.greatest(start - n, F.lit(0))
    return F.substr(text, low + 1, start - low)


def overlaps(a: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["s"] < a["e"]) & (o["e"] > a["s"]))


def expand(df: DataFrame, keys: list, structs: Column) -> DataFrame:
    """``keys`` and the fields of each struct, one row per struct.

    The outer generator and the filter behind it keep the optimizer from inferring a filter on the array's size, which
    it would push down, and inline, through every column the array is computed from.
    """
    held = df.select(*keys, F.explode_outer(structs).alias("_one")).filter(F.col("_one").isNotNull())
    return held.select(*held.columns[:-1], "_one.*")
