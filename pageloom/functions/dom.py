"""Pick things out of a page's ``nodes`` array. All of it stays in the page's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import has_token, strip
from pageloom.profile import MATH_MARKER


# No page has a node beyond it.
LAST_POSITION = (1 << 31) - 1


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def _matches(node: Column, selector: tuple) -> Column:
    tag, name, value = selector
    test = node["tag"] == tag
    if name == "class":
        test = test & has_token(attr(node, "class"), value)
    elif name is not None:
        test = test & (attr(node, name) == value)
    return F.coalesce(test, F.lit(False))


def find_root(nodes: Column, selectors: tuple[tuple, ...], whole_page: bool) -> Column:
    """H2/H3: struct(rank, pre, last) of the first node of the first selector that hits.

    Without a hit: the whole page, or null.
    """
    fallback = (
        F.struct(F.lit(len(selectors)).alias("rank"), F.lit(0).alias("pre"), F.lit(LAST_POSITION).alias("last"))
        if whole_page else F.lit(None)
    )
    if not selectors:
        return fallback

    def rank(node):
        choice = F.lit(None).cast("int")
        for i, selector in reversed(list(enumerate(selectors))):
            choice = F.when(_matches(node, selector), i).otherwise(choice)
        return choice

    tags = sorted({tag for tag, _, _ in selectors})
    candidates = F.filter(nodes, lambda n: n["tag"].isin(*tags))
    ranked = F.transform(
        candidates, lambda n: F.struct(rank(n).alias("rank"), n["pre"].alias("pre"), n["last"].alias("last"))
    )
    return F.coalesce(F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull())), fallback)


def subtree(nodes: Column, root: Column) -> Column:
    """The root's nodes, itself first; positions are array indexes, so this is a slice."""
    return F.slice(nodes, root["pre"] + 1, root["last"] - root["pre"] + 1)


def title(nodes: Column) -> Column:
    """H6: text of the first title element, null without one."""
    first = F.slice(F.filter(nodes, lambda n: n["tag"] == "title"), 1, 1)
    return F.get(F.transform(first, lambda n: page_text(subtree(nodes, n), strip_pieces=False)), F.lit(0))


def has_math(nodes: Column, marker: str = MATH_MARKER) -> Column:
    """H5: some script anywhere in the page has the marker in its src."""
    return F.exists(
        nodes, lambda n: F.coalesce((n["tag"] == "script") & attr(n, "src").contains(marker), F.lit(False))
    )


def anchors(nodes: Column, root: Column) -> Column:
    """H4: stripped hrefs inside ``root``, in document order, duplicates kept, blanks and fragments dropped.

    Positions are compared, so other nodes may be left out of the array.
    """
    hrefs = F.transform(
        F.filter(nodes, lambda n: (n["tag"] == "a") & n["pre"].between(root["pre"], root["last"]) & attr(n, "href").isNotNull()),
        lambda n: strip(attr(n, "href")),
    )
    return F.filter(hrefs, lambda h: (h != "") & ~h.startswith("#"))


def image_source(node: Column) -> Column:
    """H7: data-src unless empty, else src."""
    return F.coalesce(F.nullif(attr(node, "data-src"), F.lit("")), attr(node, "src"))


def is_image_task(node: Column, lazy_class: str) -> Column:
    """H7: an image to embed: not lazy-loaded, and its source is a web address."""
    return F.coalesce(
        (node["tag"] == "img")
        & ~has_token(attr(node, "class"), lazy_class)
        & image_source(node).startswith("http"),
        F.lit(False),
    )


def page_text(nodes: Column, separator: str = "", strip_pieces: bool = True) -> Column:
    """The strings of the nodes, without comments, scripts and styles."""
    pieces = F.transform(F.filter(nodes, lambda n: n["kind"] == "text"), lambda n: n["text"])
    if strip_pieces:
        pieces = F.filter(F.transform(pieces, strip), lambda t: t != "")
    return F.array_join(pieces, separator)
