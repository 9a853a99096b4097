"""Operators 8 and 9."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wardline.llm import html_extract, url_filter
from wardline.llm.html_blocks import blocks

URLS = [
    "http://a.example.org/es/x", "https://EXAMPLE.ORG/en/1?q=/es/", "http://example.org/en/2", "http://org/", "http://org", "http://notexample.org/es/",
    "http://shop.com/fr/a", "http://shop.com/de/a#x", "http://shop.com/it/", "http://com/de/", "ftp://x.net/y", "no scheme", "", None, "http://", "a://b://c/d",
    "http://ÄX.org/é", "http://a..org/es/", "http://x.com?de=/de/", "http://x.com/de", "http://x.com/de/" + "p" * 5_000,
]


def test_urls_match_brute_force(spark, small):
    known = [r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").select("url").collect()]
    urls = list(enumerate(known + URLS + URLS[:3]))
    df = spark.createDataFrame([(i, u, "x") for i, u in urls], "page_id long, url string, verdict string")
    for limit in (100_000, 0):
        out = url_filter.filter_urls(df, url_filter.rule_table(spark, url_filter.RULES), broadcast_rows=limit).collect()
        assert len(out) == len(urls)
        for r in out:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute.url_verdict(r["url"], url_filter.RULES)
    none = url_filter.filter_urls(df, url_filter.rule_table(spark, url_filter.RULES).filter("false"), default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"}


def test_rules_of_thousands_of_lengths_and_empty_tables(spark):
    rules = [("block" if n % 2 else "allow", "x.com", "/" + "p" * n) for n in range(4_200)]
    urls = [(n, f"http://a.x.com/{'p' * n}?q", 1) for n in (0, 1, 2, 4_095, 4_096, 4_099, 4_199, 6_000)] + [(9_000, None, 2), (9_001, "http://x.com", 3)]
    df = spark.createDataFrame(urls, "page_id long, url string, _row int")
    table = url_filter.rule_table(spark, rules)
    out = {r["page_id"]: (r["verdict"], r["_row"], len(r["rule"] or "")) for r in url_filter.filter_urls(df, table, default="none").collect()}
    for n, _, c in urls[:8]:
        longest = min(n, 4_199)
        assert out[n] == ("block" if longest % 2 else "allow", c, 6 + longest)
    assert out[9_000] == ("none", 2, 0) and out[9_001] == ("none", 3, 0)
    assert url_filter.filter_urls(df.filter("false"), table).count() == 0


def test_blocks_of_broken_html():
    texts = lambda h: [b.text for b in blocks(h)]
    assert texts("<p>a<p>b <b>c</b>d<br>e") == ["a", "b cd", "e"]
    assert texts("x &amp; y&nbsp;z<script>var a = '<p>';</script>w<!-- <p>no</p> -->v") == ["x & y zwv"]
    assert texts("") == [] and texts("<<<>>>") and texts("<p") == [] and texts("<!-- open") == []
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><svg/><p>b</p>") == ["a", "b"] and texts("<p>a</p><svg><g><text>t</text><p>b</p>c") == ["a", "t", "b", "c"]
    assert texts("see <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is <svg><title>no</title><path d='M0'/></svg>so") == ["see x+1 is so"]
    assert texts("a<noscript><p>b</p></noscript><object>c</object>d") == ["a", "b", "cd"]
    assert texts("<title>T &amp; u</title><body>x<textarea>no</textarea>y<iframe>no</iframe>z<template><p>no</p></template>w") == ["T & u", "x", "y", "z", "w"]
    assert texts("<select><option>one<option>two</select>t") == ["one", "two", "t"]
    inside, outside = blocks("<div><p>a</div>b")
    assert [t for t, _ in inside.path] == ["div", "p"] and outside.path == ()


def truth(html):
    inner = html.split("<article>", 1)[1].split("</article>", 1)[0]
    inner = re.sub(r"<(/?)b>", "", inner)
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_extraction_of_the_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_extract.extract(pages, model).collect()
    assert len(rows) == len(html) and all(r["n_chars"] == len(r["text"]) for r in rows)
    good = sum(r["text"] == truth(html[r["page_id"]]) for r in rows)
    assert good >= 0.98 * len(rows)


def test_held_out_composed_pages(model):
    composer = html_extract._Composer(991)
    right = total = 0
    for _ in range(120):
        page = blocks(composer.page())
        want = ["\x01" in b.text for b in page]
        for b in page:
            b.text = b.text.replace("\x01", "") or "."
        x, mask, _ = html_extract.padded([html_extract.features([page])])
        got = model.scores(x, mask)[:, 0] > 0
        right += sum(a == bool(b) for a, b in zip(want, got))
        total += len(page)
    assert right / total >= 0.97


#: Pages of another make than those composed, or those of the tables: (html, blocks of the article, blocks that are not).
OTHERS = [
    (
        "<html><head><title>Harbour news | Daily</title></head><body class='home'><div id='masthead'><a href='/'>Daily</a> <a href='/sport'>Sport</a> <a href='/arts'>Arts</a></div>"
        "<main><div class='story'><h1>Harbour wall to be rebuilt</h1><p>The old wall will be taken down in spring, the council said on Monday.</p><p>Work is to last two years and to cost nine million.</p>"
        "<blockquote>We have waited long enough for this.</blockquote><p>Fishers asked that the north quay stay open.</p></div>"
        "<section id='comments'><h3>3 comments</h3><ol><li><p>About time too.</p></li><li><p>And who is going to pay?</p></li></ol></section></main>"
        "<aside><h4>Most read</h4><ul><li><a href='/1'>Storm on the way</a></li><li><a href='/2'>Ferry late again</a></li></ul></aside><footer><p>Daily, all rights reserved</p></footer></body></html>",
        ["Harbour wall to be rebuilt", "The old wall will be taken down in spring, the council said on Monday.", "Work is to last two years and to cost nine million.", "We have waited long enough for this.", "Fishers asked that the north quay stay open."],
        ["About time too.", "And who is going to pay?", "Storm on the way", "Ferry late again", "Daily, all rights reserved", "3 comments"],
    ),
    (
        "<body><header><h2>A kitchen notebook</h2><nav><a href='/a'>Bread</a><a href='/b'>Soup</a></nav></header><article itemprop='articleBody'><h1>Rye bread</h1><p>Mix the flour with warm water and leave it overnight.</p>"
        "<ul><li>500 g rye flour</li><li>400 g water</li></ul><div class='newsletter'>Get our letter every week</div><p>Bake it for an hour in a hot oven.</p></article>"
        "<form><label>Search</label><select><option>All</option><option>Recipes</option></select><button>Go</button></form><div class='cookie consent'><p>We use cookies to improve this site.</p></div></body>",
        ["Rye bread", "Mix the flour with warm water and leave it overnight.", "500 g rye flour", "400 g water", "Bake it for an hour in a hot oven."],
        ["Get our letter every week", "We use cookies to improve this site.", "All", "Recipes", "Go"],
    ),
]


def test_pages_of_another_make(model):
    right = total = 0
    for html, inside, outside in OTHERS:
        text = html_extract.main_texts(model, [html])[0]
        right += sum(x in text for x in inside) + sum(x not in text.replace("Bread", "") for x in outside)
        total += len(inside) + len(outside)
    assert right >= 0.9 * total


def test_gradients_are_those_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(0)
    m = html_extract.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask, y = html_extract.padded([rng.normal(size=(5, html_extract.WIDTH)), rng.normal(size=(3, html_extract.WIDTH))], [np.array([1, 0, 1, 1, 0.0]), np.array([0, 1, 0.0])])

    def loss():
        p = html_extract._sigmoid(m.scores(x, mask))
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads = m._gradients(x, mask, y)
    for name in ("wf", "ub", "cf", "v", "c"):
        at = tuple(rng.integers(n) for n in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-3
        up = loss()
        m.p[name][at] = old - 1e-3
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 1e-3


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<html>" + "<p>word word word.</p>" * 3_000), (3, None, "<html>" + "<p>word word word.</p>" * 3_000), (4, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_extract.extract(df, model).collect()
    assert len(out) == 5 and [r["n_chars"] for r in out if r["page_id"] in (1, 2, 4)] == [0, 0, 0]
    assert len({r["text"] for r in out if r["page_id"] == 3}) == 1
    assert html_extract.extract(df.filter("false"), model).count() == 0
    # A page of more than a megabyte is read to its end.
    page = "<body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p>Sentence number {i} of a very long article, read to the end.</p>" for i in range(18_000)) + "</article></body>"
    text = html_extract.main_texts(model, [page])[0]
    assert len(page) > 1_000_000 and "Sentence number 17999 of" in text and text.count("Sentence number") > 17_900
