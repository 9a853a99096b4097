"""Plain Python versions of the operators' contracts, one row at a time and all pairs, for small fixtures."""

import hashlib
import re

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(sequences, length):
    """Per sequence (in order of occurrence) whether each unit lies in a window that also starts earlier."""
    seen, out = set(), []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            w = tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        out.append(gone)
    return out


def word_dedup(docs, length=20):
    """{doc_id: (n_words, n_removed, kept_sha256)} of [(doc_id, text)] with distinct ids."""
    docs = sorted(docs)
    rows = [words(t) for _, t in docs]
    return {
        d: (len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y)))
        for (d, _), w, g in zip(docs, rows, covered(rows, length))
    }


def byte_dedup(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    docs = sorted(docs)
    rows = [(t or "").encode() for _, t in docs]
    out = {}
    for (d, _), b, g in zip(docs, rows, covered(rows, length)):
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out[d] = (len(b), sum(g), spans, sha(bytes(c for c, x in zip(b, g) if not x)))
    return out


def shingle_set(text, k):
    w = words(lowered(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs, k=4, percent=80):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                continue
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def leaks(docs, items, k=5, threshold=0.8):
    """{(doc_id, item_id)}: containment of the item's shingles of at least the threshold."""
    out = set()
    held = [(i, shingle_set(t, k)) for i, t in items]
    for d, t in docs:
        own = shingle_set(t, k)
        out |= {(d, i) for i, s in held if s and len(s & own) >= threshold * len(s) - 1e-9}
    return out


KINDS = ("email", "ip", "card", "phone")
_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    """[(kind, start, end)] in the order of the digest."""
    found = []
    for rank, kind in enumerate(KINDS):
        for m in _BASE[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return lowered(host), path


def url_verdict(url, rules, default="allow"):
    host, path = url_parts(url)
    hits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not hits:
        return host, path, None, default
    _, verdict, rule = max(hits)
    return host, path, rule, verdict
