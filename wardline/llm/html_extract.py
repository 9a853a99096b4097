"""Main text of HTML pages with a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is read as hashed features of its tag path and a mean of hashed word
vectors; a bidirectional LSTM (numpy) reads the whole sequence, so every block is labelled with the page around it in
view. The labeller is trained here, on pages composed from a grammar of page furniture whose labels are known.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_blocks import Block, blocks
from .shared import small_batches
from .tokens import buffer_of, span_hashes, slices, word_bounds

PATH_CELLS, WORD_CELLS, PLAIN = 256, 12, 6
WIDTH = PATH_CELLS + WORD_CELLS + PLAIN
HIDDEN = 16
#: Pages that are labelled as one batch.
BATCH = 64

_WORDS = np.random.default_rng(11).normal(0, 1, (4096, WORD_CELLS)).astype(np.float32)
_cells: dict[str, int] = {}


def _cell(token: str) -> int:
    found = _cells.get(token)
    if found is None:
        found = zlib.crc32(token.encode()) % PATH_CELLS
        if len(_cells) < 50_000:
            _cells[token] = found
    return found


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages."""
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    known: dict[tuple, list[int]] = {}
    i = 0
    for page in pages:
        for k, b in enumerate(page):
            cells = known.get(b.path)
            if cells is None:
                cells = [_cell(x) for tag, names in b.path for x in (f"<{tag}>", *(f".{n}" for n in names))]
                if b.path:
                    cells += [_cell(f"leaf<{b.path[-1][0]}>")] * 2
                known[b.path] = cells
            for c in cells:
                out[i, c] = 1
            n = len(b.text)
            out[i, PATH_CELLS + WORD_CELLS :] = (
                min(np.log1p(n) / 8, 2.0), b.linked / n, len(b.path) / 10, k / len(page), b.text[-1] in ".!?:;\"')", sum(map(str.isdigit, b.text)) / n,
            )
            i += 1
    data, offsets = buffer_of(pa.array([b.text for b in flat], pa.large_string()))
    s, e, first = word_bounds(data, offsets)
    if len(s):
        vectors = _WORDS[(span_hashes(data, s, e) >> np.uint64(52)).astype(np.int64)]
        count = np.diff(first)
        full = np.flatnonzero(count)
        out[full, PATH_CELLS : PATH_CELLS + WORD_CELLS] = np.add.reduceat(vectors, first[:-1][full]) / count[full][:, None]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["v"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        steps, n, _ = x.shape
        z = x.reshape(-1, WIDTH) @ self.p[f"w{d}"] + self.p[f"c{d}"]
        z = z.reshape(steps, n, 4 * HIDDEN)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p[f"u{d}"]
            g = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tanh = np.tanh(new)
            if keep:
                saved.append((t, i, f, o, u, c, tanh, h, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, saved

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits (steps, pages) of padded sequences (steps, pages, WIDTH)."""
        f, b = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        return f @ self.p["v"][:HIDDEN] + b @ self.p["v"][HIDDEN:] + self.p["c"]

    def train(self, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, batch: int = 32, rate: float = 0.01) -> None:
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        order = sorted(range(len(sequences)), key=lambda i: len(labels[i]))
        rng = np.random.default_rng(3)
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        for _ in range(rounds):
            for k in rng.permutation(len(groups)):
                x, mask, y = padded([sequences[i] for i in groups[k]], [labels[i] for i in groups[k]])
                grads = self._gradients(x, mask, y)
                step += 1
                for name, g in grads.items():
                    np.clip(g, -1, 1, out=g)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x, mask, y):
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        logit = runs["f"][0] @ self.p["v"][:HIDDEN] + runs["b"][0] @ self.p["v"][HIDDEN:] + self.p["c"]
        delta = ((_sigmoid(logit) - y) * mask / mask.sum()).astype(np.float32)
        grads = {"c": np.array([delta.sum()], np.float32), "v": np.concatenate([np.tensordot(delta, runs[d][0], 2) for d in "fb"])}
        for d, v in (("f", self.p["v"][:HIDDEN]), ("b", self.p["v"][HIDDEN:])):
            dz = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p[f"u{d}"])
            dh_next, dc_next = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, u, c, tanh, h, m in reversed(runs[d][1]):
                dh = dh_next + delta[t][:, None] * v
                dc = m * (dc_next + dh * o * (1 - tanh * tanh))
                a = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), m * dh * tanh * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dz[t] = a
                du += h.T @ a
                dh_next = a @ self.p[f"u{d}"].T + (1 - m) * dh
                dc_next = dc * f + (1 - m) * dc_next
            grads[f"u{d}"] = du
            grads[f"w{d}"] = x.reshape(-1, WIDTH).T @ dz.reshape(-1, 4 * HIDDEN)
            grads[f"c{d}"] = dz.sum(axis=(0, 1))
        return grads


def padded(sequences, labels=None):
    steps = max(len(s) for s in sequences)
    x = np.zeros((steps, len(sequences), WIDTH), np.float32)
    mask, y = np.zeros((steps, len(sequences)), np.float32), np.zeros((steps, len(sequences)), np.float32)
    for i, s in enumerate(sequences):
        x[: len(s), i] = s
        mask[: len(s), i] = 1
        if labels is not None:
            y[: len(s), i] = labels[i]
    return x, mask, y


_SYLLABLES = "the an er on re in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve un der die und la que los con por sur dans pour mit von auf".split()


class _Composer:
    """Composes pages of known labels. Text of the article is marked, so that labels follow from the parsed blocks."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def some(self, share: float) -> bool:
        return self.rng.random() < share

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.pick(*_SYLLABLES) for _ in range(self.rng.integers(1, 4))) for _ in range(self.rng.integers(low, high)))

    def sentence(self, low=4, high=30) -> str:
        return self.words(low, high).capitalize() + self.pick(".", ".", ".", "!", "?", "")

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{self.words(1, 2)}">{self.words(1, 4)}</a></{item}>' for _ in range(n))

    def named(self, tag: str, share: float = 0.3) -> str:
        """An opening tag, at times with a class that says nothing: those of pages yet unseen mostly do."""
        return f'<{tag} class="{self.words(1, 3).replace("ad", "x")}">' if self.some(share) else f"<{tag}>"

    def furniture(self) -> str:
        return self.named("div") + self._furniture() + "</div>" if self.some(0.15) else self._furniture()

    def _furniture(self) -> str:
        r = self.rng
        kind = r.integers(11)
        if kind == 0:
            return f"<nav{self.pick('', ' class=menu', ' id=\"nav\"')}><ul>{self.links(r.integers(2, 12))}</ul></nav>"
        if kind == 1:
            return f"<div class=\"{self.pick('ad', 'ads', 'advert', 'banner ad', 'sponsored', 'promo')}\">{self.sentence(3, 40)}</div>"
        if kind == 2:
            return f"<aside{self.pick('', ' class=sidebar')}><h3>{self.words(1, 4)}</h3><ul>{self.links(r.integers(1, 8))}</ul><p>{self.sentence()}</p></aside>"
        if kind == 3:
            return f"<div class=\"{self.pick('cookie-notice', 'notice', 'consent cookie', 'alert', 'popup')}\"><p>{self.sentence(5, 40)}</p><button>{self.words(1, 3)}</button></div>"
        if kind == 4:
            choice = f"<select name=s>{''.join(f'<option>{self.words(1, 3)}</option>' for _ in range(r.integers(1, 7)))}</select>" if self.some(0.4) else ""
            return f"<form action=\"/x\"><label>{self.words(1, 4)}</label><input name=q>{choice}<button>{self.words(1, 3)}</button><p>{self.sentence(3, 15)}</p></form>"
        if kind == 5:
            body = "".join(f"<{t}><p class=\"author\">{self.words(1, 3)}</p><p>{self.sentence(3, 60)}</p></{t}>" for t in [self.pick("li", "div", "article")] * r.integers(1, 6))
            return f"<{(t := self.pick('section', 'div', 'ol'))} {self.pick('class', 'id')}=\"{self.pick('comments', 'comment-list', 'comment thread', 'responses', 'discussion')}\"><h2>{self.words(1, 3)}</h2>{body}</{t}>"
        if kind == 6:
            return f"<header{self.pick('', ' class=site-header')}><div class=logo>{self.words(1, 4)}</div><p>{self.sentence(3, 12)}</p></header>"
        if kind == 7:
            return f"<div class=\"{self.pick('sidebar', 'widget', 'related', 'share social', 'breadcrumb', 'menu', 'newsletter', 'pagination', 'tags', 'footer', 'header', 'nav')}\">{self.pick(self.links(r.integers(1, 9), 'span'), '<p>' + self.sentence() + '</p>', self.words(1, 8))}</div>"
        if kind == 8:
            return f"<footer{self.pick('', ' class=foot')}><p>&copy; {self.words(1, 5)} &middot; {self.sentence()}</p></footer>"
        if kind == 9:
            return f"<footer>&copy; {self.words(1, 3)}.example &middot; {self.sentence()}</footer>"
        return f"<div role=\"{self.pick('navigation', 'banner', 'complementary', 'search', 'contentinfo')}\">{self.words(1, 12)}</div>"

    def article(self) -> str:
        parts = []
        odd = self.some(0.1)
        if self.some(0.8):
            parts.append(f"<{(t := self.pick('h1', 'h1', 'h2'))}>\x01{self.sentence(1, 14)}</{t}>")
        for _ in range(self.rng.integers(1, 14)):
            kind = self.rng.integers(9)
            text = "\x01" + " ".join(self.sentence(1, 40) for _ in range(self.rng.integers(1, 5)))
            if self.some(0.12):
                text = "\x01" + self.pick(*[self.words(1, 2) + " ", self.words(1, 2) + ". ", self.sentence(2, 9) + " "]) * int(self.rng.integers(2, 60))
            elif self.some(0.08):
                text = text.upper()
            elif self.some(0.08):
                text = "\x01" + " ".join(w + self.pick("***", "$$$", "%%%", "&amp;&amp;", "!!", "###") for w in text[1:].split())
            elif self.some(0.05):
                text = "\x01" + self.words(1, 2)
            if kind == 0:
                parts.append(f"<h2>\x01{self.words(1, 8)}</h2><p>{text}</p>")
            elif kind == 1:
                parts.append("<ul>" + "".join(f"<li>\x01{self.sentence(1, 14)}</li>" for _ in range(self.rng.integers(1, 6))) + "</ul>")
            elif kind == 2:
                parts.append(f"{self.named('p', 0.1)}<b>{text}<br><p>\x01{self.sentence(2, 30)}</p>")
            elif kind == 3:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind == 4:
                parts.append(f"<table><tr><th>\x01{self.words(1, 4)}</th><td>\x01{self.words(1, 9)}</td></tr></table>")
            elif kind == 5:
                parts.append(f"<p>{text} <a href=\"/y\">{self.words(1, 5)}</a> {self.words(1, 9)}.</p>")
            else:
                parts.append(f"{self.named('p', 0.1)}{text}</p>")
            if self.some(0.04):
                parts.append(f"<div class=\"{self.pick('ad', 'share', 'related', 'newsletter')}\">{self.words(2, 15)}</div>")
            elif self.some(0.05):
                parts.append(self.furniture())
        if odd:
            word = self.words(1, 2) + self.pick("", ".", "!!")
            parts = [f"<p>\x01{' '.join([word] * int(self.rng.integers(1, 40)))}</p>" for _ in range(self.rng.integers(1, 12))]
            parts[0] = parts[0].replace("p>", self.pick("h1>", "p>"))
        # Furniture also stands inside the article's or the main element: a heading's, or comments behind the text.
        if self.some(0.15):
            parts.insert(0, self.furniture())
        if self.some(0.2):
            parts += [self.furniture() for _ in range(self.rng.integers(1, 4))]
        body = "".join(parts)
        kind = self.rng.integers(6)
        name = self.pick("content", "post", "entry-content", "article-body", "main", "story text")
        if self.some(0.4):
            body = f"{self.pick(self.named('div', 0.8), f'<div {self.pick('id', 'class')}=\"{name}\">')}{body}</div>"
        if kind <= 2:
            return f"{self.named('article', 0.25)}{body}</article>"
        if kind == 3:
            return f"<main><article class=\"{name}\">{body}</article></main>"
        if kind == 4:
            return f"<div {self.pick('id', 'class')}=\"{name}\">{body}</div>"
        return f"<main>{body}</main>"

    def page(self) -> str:
        before = "".join(self.furniture() for _ in range(self.rng.integers(0, 5)))
        after = "".join(self.furniture() for _ in range(self.rng.integers(0, 5)))
        if self.some(0.5):
            before = f"<nav><ul>{self.links(self.rng.integers(3, 8))}</ul></nav><div class=\"ad\">{self.sentence()}</div>" + before
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title></head><body>{before}{self.article()}{after}</body></html>"


def trained(pages: int = 600, seed: int = 17) -> Labeller:
    """A labeller fitted on composed pages; equal arguments give equal models."""
    composer = _Composer(seed)
    sequences, labels = [], []
    for _ in range(pages):
        page = blocks(composer.page())
        labels.append(np.array(["\x01" in b.text for b in page], np.float32))
        for b in page:
            b.text = b.text.replace("\x01", "") or "."
        sequences.append(features([page]))
    model = Labeller()
    model.train(sequences, labels)
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    # Pages of like length share a batch, so padding stays small.
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        chosen = order[at : at + max(1, min(BATCH, 20_000 // len(parsed[order[min(at + BATCH, len(order)) - 1]])))]
        at += len(chosen)
        rows = features([parsed[i] for i in chosen])
        cuts = np.cumsum([len(parsed[i]) for i in chosen])[:-1]
        x, mask, _ = padded(np.split(rows, cuts))
        logits = model.scores(x, mask)
        for k, i in enumerate(chosen):
            keep = logits[: len(parsed[i]), k] > 0
            out[i] = " ".join(b.text for b, y in zip(parsed[i], keep) if y)
    return out


def extract(pages: DataFrame, model: Labeller, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of ``html``; clashing columns are replaced.

    Null and empty pages, and pages of which no block is article text, give an empty text. Whole pages are read, however
    long; repeated pages give equal texts. Nothing is shuffled.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop(*(c for c in ("text", "n_chars") if c != html))
    sent = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c != html]

    def label(batches):
        for batch in batches:
            for part in slices(batch, html, 1 << 20):
                texts = main_texts(sent.value, [h or "" for h in part[html].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    fields = [pages.schema[c] for c in kept]
    return pages.mapInArrow(label, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id"), F.col("url"), F.col("html"))
    return extract(pages, trained())
