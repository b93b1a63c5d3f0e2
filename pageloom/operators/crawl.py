"""Bounded breadth-first walk over the links of stored pages.

A page's place in the walk is ``path``, the link positions from the seed to it. At equal
depth paths compare like discovery order, so no step needs a global sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators.links import link_edges
from pageloom.operators.skew import HOT_ROWS, hot_keys, number_rows, salt_many, salt_one
from pageloom.profile import CleanRules, SiteProfile
from pageloom.session import stage, stage_bucketed


@dataclass(frozen=True)
class CrawlResult:
    pages: DataFrame      # norm_url, depth, rank
    listings: DataFrame   # norm_url, depth, fetched


@dataclass(frozen=True)
class StagedEdges:
    """Edges that no step of a walk moves: in buckets by their source, or few enough to be sent along."""

    table: DataFrame
    by: tuple[str, ...]
    hot: DataFrame | None = None

    @classmethod
    def of(cls, edges: DataFrame, hot_rows: int = HOT_ROWS) -> StagedEdges:
        """From staged edges. A source with very many of them is cut into shares, each in a bucket of its own."""
        if edges.count() <= hot_rows:
            return cls(edges, ("src",))
        hot = hot_keys(edges, "src", hot_rows)
        if hot is None or hot.isEmpty():
            return cls(stage_bucketed(edges, "edges-by-src", ["src"]), ("src",))
        salted = salt_many(edges, "src", ["pos", "dst"], hot)
        return cls(stage_bucketed(salted, "edges-by-src", ["src", "_salt"]), ("src", "_salt"), hot)

    def leaving(self, frontier: DataFrame) -> DataFrame:
        """The edges of the sources in ``frontier`` (src, path), which alone is moved."""
        sources = frontier if self.hot is None else salt_one(frontier, "src", self.hot)
        return self.table.join(sources, list(self.by))


def crawl(
    pages: DataFrame, seed: str, profile: SiteProfile = SiteProfile(), hot_rows: int = HOT_ROWS, rules: CleanRules = CleanRules()
) -> CrawlResult:
    """Wanted pages reachable from ``seed`` over at most ``profile.max_depth`` listings.

    ``depth`` is the depth of the page that holds the link; the first discovery counts.
    """
    spark = pages.sparkSession
    seed = urls.known_seed(spark, seed, profile)
    edges, stored = link_edges(pages, seed, profile, rules)
    edges = StagedEdges.of(edges, hot_rows)

    frontier = spark.range(1).select(
        urls.normalize(F.lit(seed)).alias("src"), F.array().cast("array<int>").alias("path")
    )
    crawled = [frontier.select("src", F.lit(0).alias("depth"))]
    found = []
    for depth in range(profile.max_depth + 1):
        links = edges.leaving(frontier)
        if depth == profile.max_depth:
            links = links.filter("is_page")
        # min() combines on the map side, so a page everybody links to is no hot spot.
        reached = stage(
            links.groupBy("dst", "is_page").agg(F.min(F.concat("path", F.array("pos"))).alias("path")), "reached"
        )
        found.append(
            reached.filter("is_page").select(F.col("dst").alias("norm_url"), F.lit(depth).alias("depth"), "path")
        )
        listings = reached.filter("NOT is_page").select(F.col("dst").alias("src"), "path")
        if depth == profile.max_depth or listings.isEmpty():
            break
        seen = reduce(DataFrame.unionByName, crawled).select("src")
        frontier = listings.join(seen, "src", "left_anti")
        crawled.append(listings.select("src", F.lit(depth + 1).alias("depth")))

    first = (
        reduce(DataFrame.unionByName, found)
        .groupBy("norm_url").agg(F.min(F.struct("depth", "path")).alias("seen"))
        .select("norm_url", "seen.depth", "seen.path")
    )
    ranked = number_rows(first, ["depth", "path"], "rank").select("norm_url", "depth", "rank")
    read = (
        reduce(DataFrame.unionByName, crawled).groupBy(F.col("src").alias("norm_url")).agg(F.min("depth").alias("depth"))
        .join(stored.select("norm_url", F.lit(True).alias("stored")), "norm_url", "left")
        .select("norm_url", "depth", F.coalesce("stored", F.lit(False)).alias("fetched"))
    )
    return CrawlResult(ranked, read)
