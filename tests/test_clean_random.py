"""Random pages through the Spark rules and through the plain tree walk."""

import random
import time

import numpy as np
import pytest

from pageloom import CleanRules
from pageloom.operators import tree
from pageloom.operators.clean import clean_pages
from pageloom.operators.parse import parse_pages
from pageloom.sources.assets import accept_images
from plain_dom import clean

TAGS = ["p", "div", "b", "span", "i", "noscript", "a", "table", "td", "ul", "li", "style", "template", "ruby", "rt",
        "script", "form", "iframe", "section"]
STRINGS = ["x", " ", "\n", "To practice", " advertisement", "a &amp; b", "&nbsp;", "<!--c-->", "<!--To practice-->",
           "text To practice", "<br>", '<img src="/i.png">', '<img class="lazyload" data-src="http://i/a">',
           '<img src="http://i/a">', '<img src="http://i/b">', '<img data-src="http://i/b" src="y">']
ATTRIBUTES = ["", "", "", ' class="q"', ' class="z sf-mobile-ads"', ' id="comments"', ' id="respond2"', ' style="s"']


def random_html(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        if depth > 4 or rng.random() < 0.45:
            out.append(rng.choice(STRINGS))
        else:
            tag = rng.choice(TAGS)
            close = f"</{tag}>" if rng.random() < 0.9 else ""
            out.append(f"<{tag}{rng.choice(ATTRIBUTES)}>{random_html(rng, depth + 1)}{close}")
    return "".join(out)


@pytest.mark.parametrize("embed", [False, True])
def test_random_pages(spark, embed):
    rng = random.Random(11)
    sources = [f'<div class="entry-content">{random_html(rng)}{random_html(rng)}</div>' for _ in range(1500)]
    images, uris = None, None
    if embed:
        images = accept_images(spark.createDataFrame(
            [("http://i/a", "image/png", 1, bytearray(b"a"))],
            "img_url string, content_type string, content_length long, payload binary"))
        uris = {"http://i/a": "data:image/png;base64,YQ=="}
    pages = spark.createDataFrame([(i, "https://h/k", s) for i, s in enumerate(sources)],
                                  "page_id long, url string, html string").repartition(8)
    got = {r.page_id: r for r in clean_pages(parse_pages(pages), images=images, standalone=False).collect()}
    wrong = []
    for i, source in enumerate(sources):
        want = clean(source, CleanRules(), uris)
        if (got[i].clean_html, got[i].clean_text) != want:
            wrong.append((source, got[i].clean_html, want[0]))
    assert not wrong, (len(wrong), min(wrong, key=lambda w: len(w[0])))


def test_large_pages_stay_linear():
    """A chain, a flat row and a comb of a million nodes are judged in a few steps over arrays."""
    n = 1_000_000
    element = tree.BIT["alive"] | tree.BIT["judged"] | tree.BIT["closes"] | (1 << tree.OWN_SHIFT)
    string = tree.BIT["alive"] | (1 << tree.KIND_SHIFT) | (1 << tree.OWN_SHIFT)
    at = np.arange(n)
    shapes = {
        "chain": (np.full(n, n - 1), at - 1, n),
        "flat": (np.where(at == 0, n - 1, at), np.where(at == 0, -1, 0), 2),
        "comb": (np.where(at % 2 == 0, n - 1, at), np.where(at % 2 == 0, at - 2, at - 1), n // 2 + 1),
    }
    started = time.perf_counter()
    for last, parent, stay in shapes.values():
        marks = np.full(n, element)
        assert not tree.kept(last, parent, marks).any()  # elements without content, all judged
        marks[-1] = string
        alive = tree.kept(last, parent, marks)
        assert alive[-1] and alive.sum() == stay
        closes = (marks & tree.BIT["closes"]) > 0
        order = tree.written_order(alive, closes, last)
        assert len(order) == stay + (alive & closes).sum() and order[0] == 0
        assert (order[-(stay - 1) :] < 0).all()  # the string comes last, then every element that holds it ends
    assert time.perf_counter() - started < 20
