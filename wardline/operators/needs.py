"""Words without which an expression cannot match, and one search of a text for the words of all expressions.

Most expressions need words that begin where a word of the text does. One pass over the places where words begin notes the
longest of all such words at each; the others that stand there begin it. So however many words there are, each is looked
up in what was noted, and only few expressions are left to try.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

from ..functions import text as T
from .reach import Group, parse

#: Stands before each word that was found; no word has it. The other one stands for characters beyond ASCII.
_MARK, _BEYOND = "\x01", "\x02"
#: Arms of a choice that are told apart at once by their first letter.
_ARMS = 6
_SIGNS = ".^$|?*+()[]{}\\"
_LOOKS = ("(?=", "(?!", "(?<=", "(?<!")


@dataclass(frozen=True)
class Need:
    """Words in lower case, one of which a text must have, each with whether no ASCII letter stands before it."""

    words: frozenset[tuple[str, bool]]

    def shortest(self) -> int:
        return min(len(w) for w, _ in self.words)

    def told(self) -> bool:
        """Whether it is cheaply told: by words that begin where a word does (those of one or two letters stand all over a
        text), or by words of other scripts, whose first byte is rare."""
        return all(len(w) > 1 and len(w.encode()) > 2 if begins else not w[0].isascii() for w, begins in self.words)


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _literal(token: str) -> str:
    """The character that a token stands for, or nothing."""
    if len(token) == 1:
        return "" if token in _SIGNS else token
    return token[1] if len(token) == 2 and token[0] == "\\" and not token[1].isalnum() else ""


def _apart(token: str, before: bool) -> bool:
    """Whether no ASCII letter stands before what follows a token, given whether none does before the token."""
    if token == "^":
        return True
    if token.startswith("(?"):
        return before
    if token.startswith("[^"):
        return "A-Za-z" in token
    if token.startswith("["):
        rest = re.sub(r"\\[trnf]", "", token)
        return "\\" not in rest and not any(map(_letter, rest))
    return token in (r"\n", r"\t", r"\r") or bool(_literal(token)) and not _letter(_literal(token))


def _of_arm(arm: list[str | Group], apart: bool) -> tuple[list[Need], bool]:
    """What an arm needs, and whether no ASCII letter stands before what follows it."""
    found: list[Need] = []
    run, begins, i = "", False, 0
    while i < len(arm):
        x, i = arm[i], i + 1
        follows = arm[i] if i < len(arm) and isinstance(arm[i], str) else ""
        optional = follows in ("?", "*")
        repeated = optional or follows in ("+", "{")
        if follows == "{":
            close = arm.index("}", i)
            optional = "".join(map(str, arm[i + 1 : close])).split(",")[0].strip("0") == ""
            i = close
        if repeated:
            i += 1
            if i < len(arm) and arm[i] in ("?", "+"):  # lazy or possessive
                i += 1
        c = "" if optional or isinstance(x, Group) else _literal(x)
        if c:
            begins = begins if run else apart
            run += c
        if run and (repeated or not c):
            found.append(Need(frozenset([(run.lower(), begins)])))
            run = ""
        if isinstance(x, Group):
            inner, after = ([], apart) if x.opening.startswith(_LOOKS) else _of_group(x, apart)
            found += [] if optional else inner
        else:
            after = _apart(x, apart)
        apart = after and apart if optional else after
    if run:
        found.append(Need(frozenset([(run.lower(), begins)])))
    return found, apart


def _of_group(group: Group, apart: bool) -> tuple[list[Need], bool]:
    arms = [_of_arm(a, apart) for a in group.arms]
    after = all(a for _, a in arms)
    if len(arms) == 1:
        return arms[0][0], after
    # One of each arm, such as is cheaply told and has long words; an arm may leave nothing.
    best = [max(a, key=_rank, default=None) for a, _ in arms]
    return ([] if None in best else [Need(frozenset().union(*(s.words for s in best)))]), after


def _rank(need: Need) -> tuple:
    return need.told(), need.shortest(), -len(need.words)


@cache
def needs(regex: str) -> tuple[Need, ...]:
    """All that a text must have for the expression to match: of each, one word, in any case."""
    return tuple(dict.fromkeys(_of_group(parse(regex), False)[0]))


def beginnings(regexes: Iterable[str]) -> set[str]:
    """The words to note where words begin, for some expressions."""
    return {w for r in regexes for n in needs(r) if n.told() for w, begins in n.words if begins}


def inner(regexes: Iterable[str]) -> set[str]:
    """The words to note wherever they stand, for the expressions that nothing tells of cheaply."""
    return {w for r in regexes if not any(n.told() for n in needs(r)) for w in _longest(r) if len(w) > 2 and _letter(w[0])}


def _longest(regex: str) -> list[str]:
    return sorted(w for w, _ in max(needs(regex), key=_rank).words) if needs(regex) else []


def _written(tree: dict, top: bool = False) -> str:
    arms = [(T.escaped(c), _written(below), "".join(T.escaped(x) for x in below if x)) for c, below in sorted(tree.items()) if c]
    if not arms:
        return ""
    parts = [c + rest for c, rest, _ in arms]
    if top:
        # No word is one letter, so the second one tells too.
        cut = [arms[n : n + _ARMS] for n in range(0, len(arms), _ARMS)]
        parts = [f"(?=[{''.join(c for c, *_ in some)}][{''.join(sorted(set(''.join(x for *_, x in some))))}])(?:{'|'.join(c + rest for c, rest, _ in some)})" for some in cut]
    if "" in tree:
        return f"(?:{'|'.join(parts)})?"
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def noted(text: str, words: Iterable[str], begin: bool = True) -> str:
    """SQL: which of the words (in lower case) a text (SQL) has, as a string for ``possible``: where no ASCII letter stands
    before them, or anywhere."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}
    beyond = f"CASE WHEN octet_length({text}) > length({text}) THEN {T.literal(_BEYOND)} ELSE '' END"
    if not tree:
        return beyond
    before = r"(?i)\P{Alpha}" if begin else ""
    found = f"regexp_extract_all(concat(' ', {text}), {T.literal(f'{before}(?=({_written(tree, top=True)}))')}, 1)"
    return f"lower(concat({beyond}, {T.literal(_MARK)}, array_join(array_distinct({found}), {T.literal(_MARK)})))"


def _noted(hits: str, word: str) -> str:
    return f"contains({hits}, {T.literal(_MARK + word)})"


def told(regex: str, hits: str, low: str) -> str:
    """SQL: whether a text can match, as far as is cheaply told: ``hits`` is what was noted of its ``beginnings``, ``low``
    the text in lower case. Words of other scripts are looked for in texts beyond ASCII."""

    def one(need: Need) -> str:
        own = [_noted(hits, w) for w, begins in sorted(need.words) if begins]
        other = " OR ".join(f"contains({low}, {T.literal(w)})" for w, begins in sorted(need.words) if not begins)
        if other:
            own.append(f"contains({hits}, {T.literal(_BEYOND)}) AND ({other})")
        return f"({' OR '.join(own)})"

    return " AND ".join(one(n) for n in needs(regex) if n.told())


def possible(regex: str, hits: str, low: str, within: str = "") -> str:
    """SQL: ``told``, or else whether a text has the longest words that the expression needs: read off ``within``, if
    ``inner`` words were noted, else searched for."""
    words = _longest(regex)
    known = within and set(words) <= inner([regex])
    other = " OR ".join(_noted(within, w) if known else f"contains({low}, {T.literal(w)})" for w in words)
    return told(regex, hits, low) or (f"({other})" if words else "true")
