"""Cleaning vectors: what goes in between the content root's tags, and what comes out."""

import re

import pytest
from pyspark.sql import functions as F

from pageloom import CleanRules
from pageloom.operators.clean import clean_pages, clean_pieces
from pageloom.operators.images import one_per_content
from pageloom.operators.parse import parse_pages
from pageloom.sources.assets import accept_images, acceptable_images

IMG = "http://i/a.png"
VECTORS = {
    "a": ('<p>Keep</p><p><a href="/x">l</a> gone</p>', "<p>Keep</p>"),
    "b": ('<p><b><a href="/x">l</a></b> tail</p>', "<p> tail</p>"),
    "c": ("<p>To practice <b>x</b> now</p>", "<p><b>x</b> now</p>"),
    "d": ("<p>To practice all</p>", ""),
    "e": ("<p><b>To practice deep</b></p>", ""),
    "f": ("<p>advertisement</p><p>Advertisement</p>", "<p>Advertisement</p>"),
    "g": ('<div class="x sf-mobile-ads"><p>t</p></div>', ""),
    "h": ('<div id="comments">t</div><div id="comments2">u</div>', "<div>u</div>"),
    "i": ("<p> </p><div><br></div>", ""),
    "j": ("<p>a<br>b</p>", "<p>a<br/>b</p>"),
    "k": ('<div><img src="data:image/png;base64,AA=="></div>', '<div><img src="data:image/png;base64,AA=="/></div>'),
    "m": ("<noscript>t</noscript>", ""),
    "n": ('<table class="t"><tr><td style="y">v</td></tr></table><p class="x">w</p>',
          '<table class="t"><tr><td style="y">v</td></tr></table><p>w</p>'),
    "o": ("<script>x</script><form>f</form><iframe></iframe><p>k</p>", "<p>k</p>"),
    "nbsp": ("<p>&nbsp; </p><p> To practice this</p>", ""),
    "link in unwrapped noscript": (f'<div>t<noscript><a>x</a><img src="/i.png"></noscript></div><p>k</p>', "<p>k</p>"),
    "unwrapped noscript": ('<div>t<noscript>u<img src="/i.png"></noscript></div>', '<div>tu<img src="/i.png"/></div>'),
    "comment is no string": ("<p><!--advertisement-->x</p>", "<p>x</p>"),
    "lone comment": ("<p><!--c--></p><p>x</p>", "<p>x</p>"),
    "comment kept": ("<p>x<!--c--></p>", "<p>x<!--c--></p>"),
    "style survives": ("<style>p{}</style><div><style>q{}</style></div>", "<style>p{}</style>"),
    "style prefix": ("<style>advertisement{}</style><p>k</p>", "<p>k</p>"),
    "ruby text": ("<ruby>a<rt>b</rt></ruby><div><rt>c</rt></div>", "<ruby>a<rt>b</rt></ruby>"),
    "template": ("<template>t<p>u</p></template>", "<template>t</template>"),
    "ad image survives": ('<p><img class="advertisement" src="/i.png"></p>',
                          '<p><img class="advertisement" src="/i.png"/></p>'),
    "escapes": ("<p>a &lt; b &amp; c</p>", "<p>a &lt; b &amp; c</p>"),
    "quotes": ("<table b='x\"y' a=\"it's\"><tr><td>v</td></tr></table>",
               "<table b='x\"y' a=\"it's\"><tr><td>v</td></tr></table>"),
    "two strings": ("<p>To practice<br></p>", "<p><br/></p>"),
    "link deep keeps others": ("<ul><li>a</li><li><a href=x>b</a></li></ul>", "<ul><li>a</li></ul>"),
    "prefix then empty parent stays": ("<div><p>x</p>Next steps here</div>", "<div><p>x</p></div>"),
    "text blanked, parent stays": ("<div>Next steps<i>y</i></div>", "<div><i>y</i></div>"),
}
EMBED = {
    "present": (f'<img class="lazyload" data-src="{IMG}"><noscript><img src="{IMG}" alt="q"></noscript>',
                '<img src="data:image/png;base64,AAE="/>'),
    "absent": ('<img class="lazyload" data-src="http://i/b.png"><noscript><img src="http://i/b.png"></noscript>', ""),
    "local source": ('<p><img src="/x.png"></p>', '<p><img src="/x.png"/></p>'),
    "data-src first": (f'<p><img data-src="{IMG}" src="http://i/b.png"></p>',
                       '<p><img src="data:image/png;base64,AAE="/></p>'),
    "empty data-src": (f'<p><img data-src="" src="{IMG}"></p>', '<p><img src="data:image/png;base64,AAE="/></p>'),
    "failed image leaves a single string": ('<p>To practice <img src="http://i/b.png"></p><p>k</p>', "<p>k</p>"),
    "rejected type": ('<p>k<img src="http://i/c.svg"></p>', "<p>k</p>"),
}


def wrap(inner):
    return f'<html><body><div class="entry-content" id="r">{inner}</div></body></html>'


def cleaned(spark, vectors, images=None):
    rows = [(i, "https://h/k/", wrap(html)) for i, (html, _) in enumerate(vectors.values())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = clean_pages(parse_pages(pages), images=images, standalone=False)
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(vectors)
    return {name: got[i] for i, name in enumerate(vectors)}


def check(results, vectors):
    wrong = {}
    for name, (_, want) in vectors.items():
        got = results[name].clean_html
        if got != f"<div>{want}</div>":
            wrong[name] = got
    assert not wrong


def test_rules(spark):
    check(cleaned(spark, VECTORS), VECTORS)


def test_images(spark):
    assets = spark.createDataFrame(
        [(IMG, "image/png", 2, bytearray(b"\x00\x01")), ("http://i/c.svg", "image/svg+xml", 1, bytearray(b"s"))],
        "img_url string, content_type string, content_length long, payload binary",
    )
    check(cleaned(spark, EMBED, accept_images(assets)), EMBED)
    check(cleaned(spark, VECTORS, accept_images(assets)), VECTORS)


def test_hot_image_is_salted(spark):
    assets = spark.createDataFrame([(IMG, "image/png", 2, bytearray(b"\x00\x01"))],
                                   "img_url string, content_type string, content_length long, payload binary")
    pages = spark.range(300).select(
        F.col("id").alias("page_id"), F.lit("https://h/k").alias("url"),
        F.concat(F.lit(f'<article>t<img src="{IMG}"><img src="http://i/'), F.col("id").cast("string"), F.lit('"></article>')).alias("html"),
    )
    out = clean_pages(parse_pages(pages), images=accept_images(assets), standalone=False, hot_rows=20)
    rows = out.groupBy("clean_html").count().collect()
    assert [(r[0], r[1]) for r in rows] == [('<article>t<img src="data:image/png;base64,AAE="/></article>', 300)]


def test_images_are_kept_once_and_apart(spark):
    """Only shown assets are staged, equal contents once; of assets with one URL the smallest type and hash counts;
    no row of the pieces holds two images."""
    size = 200_000
    assets = [(f"http://i/{i}", "image/png", None, bytes([i // 2]) * size) for i in range(20)]
    assets += [("http://i/0", "image/gif", None, b"g"), ("http://i/unused", "image/png", None, b"u"), ("http://i/bad", "text/html", None, b"t")]
    assets = spark.createDataFrame(assets, "img_url string, content_type string, content_length long, payload binary")
    shown = "".join(f'<p>{i}<img src="http://i/{i}"></p>' for i in range(20)) + '<img src="http://i/bad">'
    rows = [(1, "u", f"<article>{shown}</article>"), (2, "u", "<article>plain</article>"), (3, "u", '<article><img src="http://i/3"></article>'), (4, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = clean_pieces(parse_pages(pages), acceptable_images(assets), standalone=False, hot_rows=2)
    assert made.shown.count() == 21 and one_per_content(made.shown).count() == 11
    pieces = sorted(made.pieces().collect(), key=lambda r: (r.page_id, r.piece))
    assert max(len(r.markup) for r in pieces) < 1.4 * size and sum(len(r.markup) for r in pieces) > 20 * 1.3 * size
    assert [r.piece for r in pieces if r.page_id == 1] == list(range(41))
    joined = {i: "".join(r.markup for r in pieces if r.page_id == i) for i in (1, 2, 3)}
    whole = {r.page_id: r.clean_html for r in made.whole().collect()}
    assert whole == joined | {4: None}
    assert joined[1].startswith('<article><p>0<img src="data:image/gif;base64,Zw=="/></p><p>1<img src="data:image/png;base64,AAAA')
    assert joined[2] == "<article>plain</article>" and joined[3].count("data:image/png;base64,AQEB") == 1 and "bad" not in joined[1]


def test_status_and_document(spark):
    math = '<script src="https://c/libs/mathjax/2.7.7/MathJax.js"></script>'
    rows = [
        (0, "https://h/k/", f"<title>t</title>{math}<article class='z'><p>x</p></article>"),
        (1, "https://h/k/", None),
        (2, "https://h/k/", "<title>Just a moment...</title><article>x</article>"),
        (3, "https://h/k/", ""),
        (4, "https://h/k/", '<script src="/MathJax.js"></script><body id=q>plain<p class=c>y</p></body>'),
        (5, "https://h/k/", "<main>m</main><div class='entry-content wide'>d</div>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in clean_pages(parse_pages(pages), CleanRules(math_hook_src="hook.js")).collect()}
    assert [got[i].status for i in range(6)] == ["ok", "missing", "challenge", "no_content", "ok", "ok"]
    assert [got[i].has_mathjax for i in (0, 4, 5)] == [True, False, False]
    assert got[0].title == "t" and got[0].file_key == "k"
    assert re.fullmatch(
        r"<!DOCTYPE html><html><head><style type=\"text/css\">.*</style><script src=\"https://polyfill.*</script>"
        r"<script src=\"hook.js\"></script>.*id=\"MathJax-script\".*</head>"
        r"<body><article><p>x</p></article></body></html>", got[0].clean_html, re.S)
    assert got[4].clean_html.endswith("</style></head><body>plain<p>y</p></body></html>")
    assert got[4].clean_text == "plainy"
    assert got[5].clean_html.endswith("<body><div>d</div></body></html>")
    assert got[1].clean_html is None and got[2].clean_text == "x"


def test_one_bad_page_does_not_fail_the_others(spark, monkeypatch):
    from pageloom.operators import htmltree

    real = htmltree.PageNumberer.read

    def read(self, html):
        real(self, html)
        if "boom" in html:
            raise ValueError("boom")

    monkeypatch.setattr(htmltree.PageNumberer, "read", read)
    rows = [(0, "u", "<article>a</article>"), (1, "u", "<article x=1>boom</article>"), (2, "u", "<article>c</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.status, r.clean_text) for r in clean_pages(parse_pages(pages)).collect()}
    assert got == {0: ("ok", "a"), 1: ("failed", None), 2: ("ok", "c")}
