"""Cut a page down to its content, inside the page's row.

What a node shows about itself becomes a few marks per node; ``operators.tree`` turns them into
the nodes that stay and the order in which they are written; the markup is put together from the
page's own array. Nothing is shuffled or sorted, and no page is unfolded into rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import dom, urls
from pageloom.functions.text import (
    escape_text, has_any_token, has_token, is_blank, quote_attribute, starts_with_any, strip,
)
from pageloom.operators import tree
from pageloom.operators.bundle import WITH_DOCUMENT
from pageloom.operators.htmltree import STRING_CONTAINERS, VOID
from pageloom.operators.images import assets_by_page, image_refs, shown_assets, with_uris
from pageloom.operators.parse import NODE_TYPE
from pageloom.operators.skew import HOT_ROWS
from pageloom.profile import MATH_CONFIG, MATH_LIBRARY_URL, PAGE_STYLE, CleanRules
from pageloom.session import stage

CONTAINERS = sorted(STRING_CONTAINERS)
UNESCAPED = ("script", "style")


def with_content(parsed: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """One row per page with its status, and ``nodes`` cut to the root.

    Status: failed (not parsed), missing (no html), no_content (no root), and of pages that
    have content challenge (by the title) or ok.
    """
    nodes = F.col("nodes")
    seen = parsed.select(
        "*",
        dom.title(nodes).alias("title"),
        F.coalesce(dom.has_math(nodes, rules.math_marker), F.lit(False)).alias("has_mathjax"),
        dom.find_root(nodes, rules.roots, whole_page=False).alias("root"),
    )
    status = (
        F.when(F.col("parse_error").isNotNull(), "failed")
        .when(nodes.isNull(), "missing")
        .when(F.col("root").isNull(), "no_content")
        .when(F.col("title").contains(rules.challenge_title), "challenge")
        .otherwise("ok")
    )
    kept = [c for c in parsed.columns if c not in ("nodes", "parse_error")]
    return (
        seen.withColumn("status", status)
        .select(
            *kept, "title", "status", "has_mathjax",
            F.col("root.pre").alias("root_pre"),
            F.when(F.col("status").isin(*WITH_DOCUMENT), dom.subtree(nodes, F.col("root"))).alias("nodes"),
        )
    )


def _rewrite(nodes: Column, **changes) -> Column:
    """The nodes with some fields replaced by functions of the node."""
    names = NODE_TYPE.fieldNames()
    return F.transform(
        nodes, lambda n: F.struct(*[(changes[f](n) if f in changes else n[f]).alias(f) for f in names])
    )


def _unwrap_noscripts(pages: DataFrame, rules: CleanRules) -> DataFrame:
    """C3 inside the page's row: a noscript with a shown image among its children becomes
    kind "unwrapped", and its children get its parent. Pages without one pass untouched.

    Noscripts do not nest, so their slices add up to no more than the page.
    """
    nodes, root_pre = F.col("nodes"), F.col("root_pre")

    def holds_image(n):
        below = F.slice(nodes, n["pre"] - root_pre + 2, n["last"] - n["pre"])
        return F.exists(below, lambda c: (c["parent"] == n["pre"]) & (c["tag"] == "img") & ~_is_lazy(c, rules))

    some = F.exists(nodes, lambda n: n["tag"] == "noscript")
    marked = _rewrite(nodes, kind=lambda n: F.when((n["tag"] == "noscript") & holds_image(n), "unwrapped").otherwise(n["kind"]))
    pages = pages.withColumn("nodes", F.when(some, marked).otherwise(nodes))

    def holder(n):
        above = F.get(nodes, n["parent"] - root_pre)
        return F.when(above["kind"] == "unwrapped", above["parent"]).otherwise(n["parent"])

    some = F.exists(nodes, lambda n: n["kind"] == "unwrapped")
    return pages.withColumn("nodes", F.when(some, _rewrite(nodes, parent=holder)).otherwise(nodes))


def _is_lazy(n: Column, rules: CleanRules) -> Column:
    return has_token(dom.attr(n, "class"), rules.lazy_class)


def _name_assets(pages: DataFrame, rules: CleanRules, mark: str) -> DataFrame:
    """I1 inside the page's row: an embedded image carries its asset's name between two marks as ``text``."""
    nodes, assets = F.col("nodes"), F.col("assets")

    def named(n):
        image = assets[n["pre"]]
        return F.concat(F.lit(mark), image["asset"], F.lit(":"), F.coalesce(image["content_type"], F.lit("")), F.lit(mark))

    placed = _rewrite(nodes, text=lambda n: F.when(dom.is_image_task(n, rules.lazy_class), named(n)).otherwise(n["text"]))
    return pages.withColumn("nodes", F.when(assets.isNotNull(), placed).otherwise(nodes)).drop("assets")


def _attributes(attrs: Column) -> Column:
    """Serialized attributes, in the order of the source."""
    entries = F.map_entries(attrs)
    return F.array_join(
        F.transform(entries, lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), quote_attribute(e["value"]))), ""
    )


def _is_boilerplate(n: Column, rules: CleanRules) -> Column:
    return F.coalesce(starts_with_any(n["text"], rules.removed_text_prefixes), F.lit(False))


def _node_marks(pages: DataFrame, rules: CleanRules, embed: bool) -> Column:
    """Whatever a node shows about itself (C1, C4, C6, C7, C9, I2), for ``tree.kept``."""
    root_pre = F.col("root_pre")
    containers = F.array(*[F.lit(c) for c in CONTAINERS])

    def marks(n):
        tag, kind, attrs, text = n["tag"], n["kind"], n["attrs"], n["text"]
        element = kind == "element"
        image = F.coalesce(tag == "img", F.lit(False))
        dead = (kind == "unwrapped") | (image & _is_lazy(n, rules))
        if embed:
            dead = dead | (dom.is_image_task(n, rules.lazy_class) & text.isNull())
        banned = (
            tag.isin(*rules.removed_tags)
            | F.coalesce(attrs["id"].isin(*rules.removed_ids), F.lit(False))
            | has_any_token(attrs["class"], rules.removed_classes)
        )
        tests = {
            "alive": ~dead,
            "judged": element & (n["pre"] != root_pre) & ~F.coalesce(tag.isin(*rules.protected_tags), F.lit(False)),
            "banned": element & banned,
            "boilerplate": _is_boilerplate(n, rules),
            "blank": is_blank(text),
            "link": tag == "a",
            "image": image,
            "closes": element & ~tag.isin(*sorted(VOID)),
        }
        bits = sum(
            (F.when(F.coalesce(test, F.lit(False)), tree.BIT[name]).otherwise(0) for name, test in tests.items()), F.lit(0)
        )
        # 1 is plain text, then the containers; nodes that are no string have 0, which is nobody's own kind.
        place = F.coalesce(F.array_position(containers, kind), F.lit(0)).cast("int")
        of_kind = F.when(place > 0, place + 1).when(kind == "text", 1).otherwise(0)
        own = F.coalesce(F.array_position(containers, tag), F.lit(0)).cast("int") + 1
        return bits + F.shiftleft(of_kind, tree.KIND_SHIFT) + F.shiftleft(own, tree.OWN_SHIFT)

    return F.transform("nodes", lambda n: F.struct(
        (n["last"] - root_pre).alias("last"),
        F.greatest(n["parent"] - root_pre, F.lit(-1)).alias("parent"),
        marks(n).alias("marks"),
    ))


def head_markup(has_mathjax: Column, rules: CleanRules) -> Column:
    """C14: the head of the standalone document."""
    hook = f'<script src="{rules.math_hook_src}"></script>' if rules.math_hook_src else ""
    polyfill = f'<script src="{rules.polyfill_url}"></script>' if rules.polyfill_url else ""
    math = (
        f'{polyfill}{hook}'
        f'<script type="text/x-mathjax-config">{MATH_CONFIG}</script>'
        f'<script async="" id="MathJax-script" src="{MATH_LIBRARY_URL}"></script>'
    )
    style = f'<style type="text/css">{PAGE_STYLE}</style>'
    return F.concat(F.lit(f"<head>{style}"), F.when(has_mathjax, math).otherwise(""), F.lit("</head>"))


def _opening(n: Column, root_pre: Column, rules: CleanRules) -> Column:
    """What a node that stays writes before its content."""
    tag, kind, text = n["tag"], n["kind"], n["text"]
    written = (
        F.when(n["pre"] == root_pre, "")
        .when((tag == "img") & text.isNotNull(), F.concat(F.lit(" src="), text))
        .when(tag.isin(*rules.attribute_tags, *rules.protected_tags), _attributes(n["attrs"]))
        .otherwise("")
    )
    end = F.when(tag.isin(*sorted(VOID)), "/>").otherwise(">")
    return (
        F.when(kind == "element", F.concat(F.lit("<"), tag, written, end))
        .when(_is_boilerplate(n, rules), "")
        .when(kind.isin(*UNESCAPED), text)
        .when(kind == "comment", F.when(text == "", "").otherwise(F.concat(F.lit("<!--"), text, F.lit("-->"))))
        .otherwise(escape_text(text))
    )


def _serialize(pages: DataFrame, rules: CleanRules, standalone: bool) -> DataFrame:
    """C12, C14-C16 from ``order``, which is null where there is no document."""
    nodes, order, root_pre = F.col("nodes"), F.col("order"), F.col("root_pre")
    placed = F.transform(order, lambda o: F.struct(
        (o < 0).alias("ends"), F.get(nodes, F.when(o < 0, -1 - o).otherwise(o)).alias("n")
    ))
    content = F.array_join(F.transform(placed, lambda p: F.when(
        p["ends"], F.concat(F.lit("</"), p["n"]["tag"], F.lit(">"))
    ).otherwise(_opening(p["n"], root_pre, rules))), "")
    said = F.filter(placed, lambda p: (p["n"]["kind"] == "text") & ~_is_boilerplate(p["n"], rules))
    texts = F.filter(F.transform(said, lambda p: strip(p["n"]["text"])), lambda t: t != "")
    html = content
    if standalone:
        whole = F.get(nodes, F.lit(0))["tag"] == "body"
        html = F.concat(
            F.lit("<!DOCTYPE html><html>"), head_markup(F.col("has_mathjax"), rules),
            F.when(whole, content).otherwise(F.concat(F.lit("<body>"), content, F.lit("</body>"))),
            F.lit("</html>"),
        )
    kept = [c for c in pages.columns if c not in ("page_id", "nodes", "root_pre", "order")]
    return pages.select(
        "page_id",
        *kept,
        F.when(order.isNotNull(), html).alias("clean_html"),
        F.when(order.isNotNull(), F.array_join(texts, rules.text_separator)).alias("clean_text"),
    )


def _cleaned(pages: DataFrame, rules: CleanRules, standalone: bool, embed: bool) -> DataFrame:
    pages = _unwrap_noscripts(pages, rules)
    marked = pages.withColumn("order", tree.kept_order(_node_marks(pages, rules, embed)))
    return _serialize(marked, rules, standalone)


@dataclass(frozen=True)
class CleanPieces:
    """Cleaned pages whose images are kept apart from their markup."""

    pages: DataFrame   # staged: one row per page; ``clean_html`` names its images between marks
    shown: DataFrame   # staged: the assets that pages show, by the hash of their content
    mark: str
    hot_rows: int

    def _named(self) -> Column:
        return F.coalesce(F.col("clean_html").contains(self.mark), F.lit(False))

    def _images(self) -> DataFrame:
        """(page_id, piece, markup): the images, at their places among the pieces of their page."""
        split = self.pages.filter(self._named()).select("page_id", F.posexplode(F.split("clean_html", self.mark)).alias("piece", "markup"))
        name = F.split("markup", ":", 2)
        uses = split.filter("piece % 2 = 1").select("page_id", "piece", name[0].alias("asset"), name[1].alias("content_type"))
        images = with_uris(uses, self.shown, ["page_id", "piece"], self.hot_rows)
        return images.select("page_id", "piece", quote_attribute(F.col("data_uri")).alias("markup"))

    def pieces(self) -> DataFrame:
        """(page_id, piece, markup): the documents in ordered pieces; a row holds markup or one image, never two."""
        split = self.pages.filter(self._named()).select("page_id", F.posexplode(F.split("clean_html", self.mark)).alias("piece", "markup"))
        whole = self.pages.filter(~self._named() & F.col("clean_html").isNotNull())
        return (
            split.filter("piece % 2 = 0").unionByName(self._images())
            .unionByName(whole.select("page_id", F.lit(0).alias("piece"), F.col("clean_html").alias("markup")))
        )

    def whole(self) -> DataFrame:
        """The pages with whole documents, each of which must fit one row.

        A page moves as one row to its images, and none is gathered before it has moved.
        """
        others = [c for c in self.pages.columns if c != "page_id"]
        pages = self.pages.filter(self._named()).select("page_id", F.struct(*others).alias("page"))
        rows = pages.unionByName(self._images().select("page_id", F.struct("piece", "markup").alias("image")), allowMissingColumns=True)
        met = rows.repartition("page_id").groupBy("page_id").agg(
            F.first("page", True).alias("page"), F.array_sort(F.collect_list("image")).alias("images")
        )
        # Every name between two marks is an image, so the odd pieces are the images in order.
        placed = F.transform(F.split("page.clean_html", self.mark), lambda piece, at: F.when(
            at % 2 == 1, F.get("images", F.shiftright(at, 1))["markup"]
        ).otherwise(piece))
        joined = met.select("page_id", "page.*", F.array_join(placed, "").alias("_html"))
        return self.pages.filter(~self._named()).unionByName(joined.drop("clean_html").withColumnRenamed("_html", "clean_html"))


def clean_pieces(
    parsed: DataFrame, images: DataFrame, rules: CleanRules = CleanRules(), standalone: bool = True, hot_rows: int = HOT_ROWS
) -> CleanPieces:
    """C17 with I1 for pages of any weight: what a page shows is named by the hash of its content
    while the page is cleaned, and joined to it piece by piece."""
    pages = stage(with_content(parsed, rules).withColumn("file_key", urls.file_key(F.col("url"))), "content")
    refs = stage(image_refs(pages, rules), "image-refs")
    shown = shown_assets(refs, images)
    mark = uuid.uuid4().hex  # in no page
    named = _name_assets(pages.join(assets_by_page(refs, shown, hot_rows), "page_id", "left"), rules, mark)
    return CleanPieces(stage(_cleaned(named, rules, standalone, embed=True), "cleaned"), shown, mark, hot_rows)


def clean_pages(
    parsed: DataFrame,
    rules: CleanRules = CleanRules(),
    images: DataFrame | None = None,
    standalone: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """C17: one row per input page: its columns, file_key, title, status, has_mathjax,
    clean_html and clean_text.

    ``images`` holds the accepted assets, encoded (img_url, data_uri) or not yet (img_url,
    content_type, payload). Given, every web image is
    embedded or dropped; left out, images stay as they are. ``standalone=False`` leaves
    the content root unwrapped. ``page_id`` must be unique.
    """
    if images is not None:
        return clean_pieces(parsed, images, rules, standalone, hot_rows).whole()
    pages = with_content(parsed, rules).withColumn("file_key", urls.file_key(F.col("url")))
    return _cleaned(pages, rules, standalone, embed=False)
