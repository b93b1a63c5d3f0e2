"""The two ways to run everything."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators.bundle import WITH_DOCUMENT, bundle_members, bundle_name, bundle_parts, failed_members, last_of_staged
from pageloom.operators.clean import clean_pages
from pageloom.operators.crawl import crawl
from pageloom.operators.parse import parse_pages
from pageloom.profile import CleanRules, SiteProfile
from pageloom.session import stage, written
from pageloom.sources.pages import fetch_pages, resolve_attempts


# All that can become of a wanted page.
STATUSES = (*WITH_DOCUMENT, "no_content", "missing", "failed")


@dataclass(frozen=True)
class RunResult:
    outcomes: DataFrame   # one row per wanted page, whatever became of it
    documents: DataFrame  # the last document per file_key
    bundles: DataFrame    # the documents of the subject, in crawl order
    failed: DataFrame     # A3: the pages that no document came of
    name: str             # A4: the bundle's name, from the time of the run
    subject: str          # A4: the key of the bundle
    counts: dict[str, int]  # A1: pages, and those of each status, counted while the outcomes were written

    def members(self) -> DataFrame:
        """A2 for documents of any size: (subject, member, start, length, rank, file_key), without their bodies."""
        return bundle_members(self.documents.withColumn("subject", F.lit(self.subject)), "subject", ["rank", "file_key"], "clean_html")


def _outcomes(fetched: DataFrame, rules: CleanRules, images: DataFrame | None) -> DataFrame:
    """Clean what was found; what is not stored stays as a row of status missing."""
    parsed = parse_pages(fetched.filter("page_id IS NOT NULL"), keep=("page_id", "url", "depth", "rank"))
    missing = fetched.filter("page_id IS NULL").select(
        "page_id", "url", "depth", "rank",
        F.lit("missing").alias("status"), urls.file_key(F.col("url")).alias("file_key"),
    )
    return clean_pages(parsed, rules, images).unionByName(missing, allowMissingColumns=True)


def clean_typed(
    pages: DataFrame, typed: DataFrame, rules: CleanRules = CleanRules(), images: DataFrame | None = None
) -> DataFrame:
    """One outcome per URL of ``typed`` (url, rank), fetched and named as typed.

    A scheme is put in front where none is, blank URLs drop out, and a fragment is not part
    of what is fetched; nothing else is normalized and no site profile is asked. A page that
    several typed URLs ask for is cleaned once.
    """
    full = typed.select(urls.ensure_scheme(F.col("url")).alias("url"), "rank").filter("url IS NOT NULL")
    asked = full.groupBy("url").agg(F.min("rank").alias("rank")).withColumn("address", urls.requested(F.col("url")))
    wanted = asked.groupBy(F.col("address").alias("norm_url")).agg(F.min("rank").alias("rank"))
    fetched = fetch_pages(wanted.select("norm_url", F.lit(0).alias("depth"), "rank"), pages, address=urls.requested, rules=rules)
    outcomes = _outcomes(fetched, rules, images).drop("rank", "file_key").withColumnRenamed("url", "address")
    named = asked.join(outcomes, "address").drop("address")
    return named.withColumn("file_key", urls.file_key(F.col("url")))


def clean_listed(
    pages: DataFrame, wanted_urls: list[str], rules: CleanRules = CleanRules(), images: DataFrame | None = None
) -> DataFrame:
    """A6 for a list typed by hand; its URLs reach the scan of the stored pages."""
    listed = pages.sparkSession.createDataFrame(list(enumerate(wanted_urls, 1)), "rank long, url string")
    asked = [urls.requested(urls.ensure_scheme(F.lit(url))) for url in wanted_urls]
    tests = [(F.col("url") == a) | F.col("url").startswith(F.concat(a, F.lit("#"))) for a in asked]
    return clean_typed(pages.filter(reduce(Column.__or__, tests, F.lit(False))), listed, rules, images)


def run_bulk(
    pages: DataFrame,
    seed: str,
    profile: SiteProfile = SiteProfile(),
    rules: CleanRules = CleanRules(),
    images: DataFrame | None = None,
    width: int = 100,
    attempts: DataFrame | None = None,
    run_time: datetime | None = None,
    done: DataFrame | None = None,
    outcomes_path: str | None = None,
) -> RunResult:
    """Crawl from ``seed``, clean what was found, keep one document per key, bundle.

    A bundle's part holds the documents of ``width`` consecutive ranks, whatever their size.
    ``attempts`` (url, attempt, outcome) are the tries to get a page: one that they never
    got counts as failed, stored or not; a page without attempts counts as got.
    ``run_time`` names the bundle; left out, it is the time of the call. Pages in ``done``
    (norm_url) are left to the runs that made them; links are followed past them.
    Given ``outcomes_path``, the outcomes are written there, over what it holds, instead of being staged.
    """
    spark = pages.sparkSession
    seed = urls.known_seed(spark, seed, profile)
    found = crawl(pages, seed, profile, rules=rules).pages
    if done is not None:
        found = found.join(done.select("norm_url"), "norm_url", "left_anti")
    lost = None
    if attempts is not None:
        tries = attempts.select(urls.normalize(F.col("url")).alias("norm_url"), "attempt", "outcome")
        final = resolve_attempts(tries, "norm_url", ["attempt"], F.col("outcome"))
        lost = stage(final.filter("status = 'failed'").select("norm_url"), "lost")
        found = stage(found, "found")
    reached = found if lost is None else found.join(lost, "norm_url", "left_anti")
    fetched = fetch_pages(reached, pages, urls.may_be_wanted(F.col("norm_url"), profile), rules=rules)
    outcomes = _outcomes(fetched, rules, images)
    if lost is not None:
        given_up = found.join(lost, "norm_url", "left_semi").select(
            F.col("norm_url").alias("url"), "depth", "rank",
            F.lit("failed").alias("status"), urls.file_key(F.col("norm_url")).alias("file_key"),
        )
        outcomes = outcomes.unionByName(given_up, allowMissingColumns=True)
    seen = Observation()
    by_status = [F.count_if(F.col("status") == status).alias(status) for status in STATUSES]
    counted = outcomes.observe(seen, F.count("*").alias("pages"), *by_status)
    outcomes = stage(counted, "outcomes") if outcomes_path is None else written(counted, outcomes_path)
    documents = last_of_staged(outcomes.filter(F.col("status").isin(*WITH_DOCUMENT)), ["rank"])
    subject = "-".join(urls.keyword_list(spark, seed, profile))
    bundles = bundle_parts(documents.withColumn("subject", F.lit(subject)), "subject", "rank", "clean_html", width, first=1)
    at = F.current_timestamp() if run_time is None else F.lit(run_time)
    name = spark.range(1).select(bundle_name(at)).first()[0]
    return RunResult(outcomes, documents, bundles, failed_members(outcomes), name, subject, seen.get)
