"""H4, G1: the links of a page, and the edges a crawl can use. No shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import dom, urls
from pageloom.functions.bind import bind
from pageloom.operators.parse import parse_pages
from pageloom.profile import CleanRules, SiteProfile
from pageloom.session import stage


def link_tags(profile: SiteProfile) -> frozenset[str]:
    """The elements that links are found by."""
    return frozenset(("a", *(tag for tag, _, _ in profile.link_roots)))


def page_links(parsed: DataFrame, profile: SiteProfile = SiteProfile()) -> DataFrame:
    """(page_id, url, pos, href, abs_url), document order, duplicates kept. Nodes of ``link_tags`` are enough."""
    nodes = F.col("nodes")
    rooted = parsed.select(
        "page_id", "url", "nodes", dom.find_root(nodes, profile.link_roots, whole_page=True).alias("root")
    )
    based = rooted.withColumns(
        {"base_scheme": urls.scheme(F.col("url")), "base_netloc": urls.netloc(F.col("url"))}
    )
    links = based.select(
        "page_id", "url", "base_scheme", "base_netloc", F.posexplode(dom.anchors(nodes, F.col("root"))).alias("pos", "href")
    ).withColumns(urls.link_parts(F.col("href")))
    joined = urls.join_parts(*[F.col(c) for c in ("link", "own", "rest", "base_scheme", "base_netloc")])
    return links.select("page_id", "url", "pos", "href", joined.alias("abs_url"))


def choose_snapshots(
    versions: DataFrame, pages: DataFrame, near: Column | None = None, rules: CleanRules = CleanRules(), likely: Column | None = None
) -> DataFrame:
    """Of the stored pages of one URL the one that counts: (norm_url, page_id).

    ``versions`` is staged (norm_url, page_id). A page that is there and no challenge comes
    before a challenge, and that before an empty or missing one; of equals the smallest
    ``page_id``. Only pages of URLs with several are looked at, and only their title is kept.
    """
    counted = versions.groupBy("norm_url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    several = stage(versions.join(counted.filter("n > 1").select("norm_url"), "norm_url", "left_semi"), "versions")
    alone = counted.filter("n = 1").select("norm_url", "page_id")
    if several.isEmpty():
        return alone
    seen = parse_pages(with_html(several, pages, near, likely), keep=("norm_url", "page_id"))
    nodes = F.col("nodes")
    worth = (
        F.when(F.coalesce(F.size(nodes), F.lit(0)) <= 0, 2)
        .when(F.coalesce(dom.title(nodes).contains(rules.challenge_title), F.lit(False)), 1).otherwise(0)
    )
    best = F.min(F.struct(worth.alias("worth"), "page_id")).alias("best")
    return alone.unionByName(seen.groupBy("norm_url").agg(best).select("norm_url", "best.page_id"))


# Ranges of page_id that one scan is asked for.
RANGES = 64


def id_ranges(ids: DataFrame, ranges: int = RANGES) -> Column:
    """A test on ``page_id`` that holds for all of ``ids`` and that a scan can use to skip row groups.

    At most ``ranges`` pairs of numbers come to the driver. On a table clustered by site
    the ranges are narrow; on any other they rule out little and cost little.
    """
    low, high = ids.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return F.lit(False)
    width = (high - low) / ranges + 1
    spans = (
        ids.groupBy(F.floor((F.col("page_id").cast("double") - F.lit(float(low))) / width))
        .agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).collect()
    )
    return reduce(Column.__or__, (F.col("page_id").between(s.low, s.high) for s in spans))


# Single URLs that a scan is asked for one by one, so that it can use Bloom filters; Spark hands
# lists of at most ten to the Parquet reader as they are.
POINTS, PER_LIST = 200, 10
# Longer URLs are cut in the ranges, below for the smallest, open above for the largest.
LONGEST_BOUND = 1000


def url_ranges(wanted: DataFrame, ranges: int = RANGES, points: int = POINTS) -> Column:
    """A test on ``norm_url`` that holds for all of ``wanted`` and that a scan can use to skip row groups.

    Few URLs are named one by one, more by ranges of about as many wanted URLs each; at most
    ``points`` URLs or ``ranges`` pairs come to the driver.
    """
    url = F.col("norm_url")
    few = [r.norm_url for r in wanted.select(F.left(url, F.lit(LONGEST_BOUND + 1)).alias("norm_url")).filter("norm_url IS NOT NULL").limit(points + 1).collect()]
    if not few:
        return F.lit(False)
    if len(few) <= points and max(map(len, few)) <= LONGEST_BOUND:
        few = sorted(set(few))
        return reduce(Column.__or__, (url.isin(few[i : i + PER_LIST]) for i in range(0, len(few), PER_LIST)))
    spans = (
        wanted.select("norm_url").filter("norm_url IS NOT NULL").repartitionByRange(ranges, "norm_url")
        .groupBy(F.spark_partition_id().alias("part")).agg(F.min("norm_url").alias("low"), F.max("norm_url").alias("high"))
        .select(F.left("low", F.lit(LONGEST_BOUND)).alias("low"), F.when(F.length("high") <= LONGEST_BOUND, F.col("high")).alias("high"))
        .collect()
    )
    return reduce(Column.__or__, ((url >= s.low) & (F.lit(True) if s.high is None else url <= s.high) for s in spans))


def with_html(chosen: DataFrame, pages: DataFrame, near: Column | None = None, likely: Column | None = None, shares: int | None = None) -> DataFrame:
    """A staged table of pages with their html, which only this scan reads.

    ``near`` is a test on the stored pages that holds for all of ``chosen``; ranges of
    ``page_id`` unless given. ``likely``, a test on ``norm_url`` that holds for them too, keeps
    the html of other pages in the way of a scan out of the join.
    """
    html = pages.filter(id_ranges(chosen) if near is None else near)
    if likely is not None:
        html = with_norm_url(html).filter(likely)
    html = html.select("page_id", "html")
    return chosen.join(html if shares is None else html.repartition(shares, "page_id"), "page_id")


def is_clustered(pages: DataFrame) -> bool:
    """Whether the normalized URL is stored, as ``sources.layout`` does it."""
    return "norm_url" in pages.columns


def with_norm_url(pages: DataFrame) -> DataFrame:
    return pages if is_clustered(pages) else bind(pages, norm_url=urls.normalize(F.col("url")))


def addresses(pages: DataFrame) -> DataFrame:
    """(page_id, url, norm_url) of the stored pages, from a scan that reads no html."""
    return with_norm_url(pages.drop("html")).select("page_id", "url", "norm_url")


def _edges_from(html: DataFrame, seed: str, keywords: list[str], profile: SiteProfile) -> DataFrame:
    """(src, pos, dst, is_page) of pages with (norm_url, page_id, html): the links that a crawl can use."""
    listing, link = F.lit(seed), F.col("abs_url")
    parsed = parse_pages(html.withColumnRenamed("norm_url", "url"), tags=link_tags(profile))
    links = page_links(parsed, profile).select(F.col("url").alias("src"), "pos", "abs_url")
    parts = bind(links, netloc=urls.netloc(link), path=urls.path(link))
    netloc, path = F.col("netloc"), F.col("path")
    judged = bind(
        parts,
        dst=urls.normalized(netloc, path),
        kind=urls.classify(link, netloc, path, listing, keywords, profile),
    )
    edges = judged.filter((F.col("dst") != urls.normalize(listing)) & F.col("kind").isNotNull())
    return edges.select("src", "pos", "dst", (F.col("kind") == "page").alias("is_page"))


def link_edges(
    pages: DataFrame, seed: str, profile: SiteProfile = SiteProfile(), rules: CleanRules = CleanRules()
) -> tuple[DataFrame, DataFrame]:
    """Staged edges (src, pos, dst, is_page) a crawl from ``seed`` can use, and the stored listings.

    Whether a page can be crawled at all shows in its URL, so a scan of the URLs alone
    finds those whose html is read. A URL that looks like a page can only be crawled where a
    link to it is none to a page (such as one with "feed" in its query): html of these is read
    once an edge asks for it, in at most ``profile.max_depth`` rounds, as no walk goes further.
    """
    spark, norm = pages.sparkSession, F.col("norm_url")
    shares = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seed_norm = urls.normalize(F.lit(seed))
    keywords = urls.keyword_list(spark, seed, profile)
    likely = (norm == seed_norm) | urls.may_be_listing(norm, keywords, profile)
    pagelike = (norm != seed_norm) & urls.looks_like_page(norm, profile)
    versions = stage(addresses(pages).filter(likely).select("norm_url", "page_id", pagelike.alias("pagelike")), "listing-versions")

    def read(listed: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
        near = url_ranges(listed) if is_clustered(pages) else None
        stored = stage(choose_snapshots(listed, pages, near, rules, test), "listings")
        # Links compress well and cost much: shares of them are dealt out by their number, not by their bytes.
        html = with_html(stored, pages, near, test, shares)
        return stage(_edges_from(html, seed, keywords, profile), "edges"), stored

    edges, stored = read(versions.filter("NOT pagelike").drop("pagelike"), likely & ~pagelike)
    rest, last = versions.filter("pagelike").drop("pagelike"), edges
    for _ in range(profile.max_depth):
        asked = last.filter(~F.col("is_page") & urls.looks_like_page(F.col("dst"), profile)).select(F.col("dst").alias("norm_url"))
        more = stage(rest.join(asked.distinct(), "norm_url", "left_semi"), "asked-listings")
        if more.isEmpty():
            break
        rest = rest.join(more.select("norm_url").distinct(), "norm_url", "left_anti")
        last, found = read(more, likely & pagelike)
        edges, stored = edges.unionByName(last), stored.unionByName(found)
    return edges, stored
