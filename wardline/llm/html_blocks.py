"""Text blocks of HTML pages, with the path of tags each lies under. Tolerant of unclosed and crossed tags."""

from __future__ import annotations

import re
from html import unescape

#: A comment, a declaration, an element whose content is no markup, or a tag. Script, style, and iframe hold no text of the
#: page; a text area's is a form's, a title's a block of its own. One that is never closed reaches to the end of the page.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(script|style|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<title\b[^>]*>(?P<title>.*?)(?:</title\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr svg math noscript object".split())
#: Elements of a picture or a formula may close themselves.
_FOREIGN = frozenset(("svg", "math"))
#: What is under these is never shown.
_HIDDEN = frozenset(("template",))
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag ends open ones of these, up to the named holder.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[tuple[str, tuple[str, ...]], ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(html: str) -> list[Block]:
    """All blocks with text, in page order: white space collapsed, references decoded, their tag paths and linked characters."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    at = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text and not any(t in _HIDDEN for t, _ in stack):
            out.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), min(linked, len(text))))
        parts.clear()
        linked = 0

    for m in _MARKUP.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1]:
            if m[1].lower() in ("iframe", "textarea"):
                flush()
            continue
        if m["title"] is not None:
            # Inside a picture a title is a label, elsewhere the page's.
            if not any(t == "svg" for t, _ in stack):
                flush()
                stack.append(("title", ()))
                add(m["title"])
                flush()
                stack.pop()
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        foreign = next((k for k, (t, _) in enumerate(stack) if t in _FOREIGN), None)
        if foreign is not None and (tag in _CLOSES_P or tag in _ENDS or tag == "body"):
            # A block of the page ends a picture or formula that was never closed.
            del stack[foreign:]
            foreign = None
        if tag not in INLINE and foreign is None:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and tag not in _FOREIGN and stack[k][0] not in INLINE:
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in _ENDS:
            ends, holders = _ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in holders:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    break
        if tag in VOID or m["rest"].endswith("/") and (foreign is not None or tag in _FOREIGN or tag not in INLINE):
            continue
        names: tuple[str, ...] = ()
        if "=" in m["rest"]:
            names = tuple(dict.fromkeys(t for g in _NAMES.findall(m["rest"]) for t in _TOKEN.findall("".join(g).lower())))
        stack.append((tag, names))
    if at < len(html):
        rest = html[at:]
        add(rest)
    flush()
    return out
