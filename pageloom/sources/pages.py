"""Stored pages as the thing that is "fetched", and the attempts to get them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.bind import bind
from pageloom.operators.links import addresses, choose_snapshots, is_clustered, url_ranges, with_html
from pageloom.profile import MAX_ATTEMPTS, CleanRules
from pageloom.session import stage


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html); ``page_id`` is unique."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def spread_pages(pages: DataFrame) -> DataFrame:
    """Give every core work when a small input sits in a few files; a no-op on large tables."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores, "page_id")


def fetch_pages(
    wanted: DataFrame, pages: DataFrame, likely: Column | None = None, address: Callable[[Column], Column] = urls.normalize,
    rules: CleanRules = CleanRules(),
) -> DataFrame:
    """Left join the wanted list (norm_url, depth, rank) to its stored pages.

    ``likely`` is a test on ``norm_url`` that holds for every wanted page and rules out
    nearly all others; without it every stored page is considered. ``address`` makes the
    ``norm_url`` of a stored URL. Of several stored pages of a URL ``choose_snapshots``
    takes one; only then the html of what is wanted is read. Without a stored page ``page_id`` and ``html`` are null.

    On pages clustered by URL (``sources.layout``) both scans skip what lies far from the
    wanted URLs; on others the html scan skips by ``page_id``.
    """
    stored, near, wanted = pages, None, stage(wanted, "asked")
    if is_clustered(pages):
        sought = wanted.select("norm_url") if address is urls.normalize else wanted.select(urls.normalize(F.col("norm_url")).alias("norm_url"))
        near = url_ranges(sought)
        stored = stored.filter(near)
    stored = addresses(stored)
    if address is not urls.normalize:
        stored = bind(stored.drop("norm_url"), norm_url=address(F.col("url")))
    if likely is not None:
        stored = stored.filter(likely)
    asked = wanted.select("norm_url").distinct()
    versions = stage(stored.select("norm_url", "page_id").join(asked, "norm_url", "left_semi"), "wanted-versions")
    test = likely if address is urls.normalize else None  # a stored page's own ``norm_url`` is the normalized one
    chosen = stage(wanted.join(choose_snapshots(versions, pages, near, rules, test), "norm_url", "left"), "wanted")
    listed = ("page_id", F.col("norm_url").alias("url"), "depth", "rank")
    present = with_html(chosen.filter("page_id IS NOT NULL"), pages, near, test)
    missing = chosen.filter("page_id IS NULL")
    return present.select(*listed, "html").unionByName(
        missing.select(*listed, F.lit(None).cast("string").alias("html"))
    )


def resolve_attempts(
    attempts: DataFrame, key: str, order: list[str], outcome: Column, limit: int = MAX_ATTEMPTS
) -> DataFrame:
    """S3: (key, attempts, status) from rows with ``outcome`` 'ok', 'rejected' or 'error'.

    Only an error is tried again, up to ``limit``; the first other outcome is final.
    The limit is applied before the shuffle too, so a key with many rows stays cheap.
    """
    window = Window.partitionBy(key).orderBy(*order)
    tried = (
        attempts.select(key, *order, outcome.alias("outcome"))
        .withColumn("attempt", F.row_number().over(window))
        .filter(F.col("attempt") <= limit)
    )
    final = F.min(F.when(F.col("outcome") != "error", F.struct("attempt", "outcome")))
    return (
        tried.groupBy(key).agg(final.alias("final"), F.max("attempt").alias("last"))
        .select(
            key,
            F.coalesce("final.attempt", "last").cast("bigint").alias("attempts"),
            F.when(F.col("final.outcome") == "ok", "ok").otherwise("failed").alias("status"),
        )
    )
