"""Pages laid out by URL: what a lookup reads, on ids in no order, and that every run gives the same on them."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators.links import LONGEST_BOUND, url_ranges
from pageloom.plans.runs import clean_listed, run_bulk
from pageloom.sources.layout import read_clustered, write_clustered
from pageloom.sources.pages import fetch_pages
from test_crawl import SEED, page_table

N = 20_000


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    """Twenty thousand pages of forty sites with shuffled ids, in small row groups."""
    path = str(tmp_path_factory.mktemp("layout") / "pages")
    order = list(range(N))
    random.Random(5).shuffle(order)
    rows = [(i, f"http://h{k % 40:02}.example.org/p{k:06}/?x=1", f"<p>{k} " + f"{k * 7919 % 100_003} " * 60) for i, k in enumerate(order)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_clustered(pages, path, files=4, group_bytes=64 << 10, group_urls=1000)
    return read_clustered(spark, path)


def scanned(df):
    """Rows that the scans of html decoded, after the query ran."""
    def scans(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scans(plan.plan())
        if kind == "FileSourceScanExec":
            return [plan] if "html" in plan.schema().simpleString() else []
        children = plan.children()
        return [s for i in range(children.size()) for s in scans(children.apply(i))]

    df.collect()
    return sum(s.metrics().apply("numOutputRows").value() for s in scans(df._jdf.queryExecution().executedPlan()))


def wanted_of(spark, numbers):
    rows = [(f"https://h{k % 40:02}.example.org/p{k:06}", 0, i) for i, k in enumerate(numbers)]
    return spark.createDataFrame(rows, "norm_url string, depth int, rank long")


def test_single_urls_read_few_row_groups(spark, laid):
    df = fetch_pages(wanted_of(spark, [7, 11_111, 19_998]), laid)
    assert 3 <= scanned(df) < N / 20
    assert sorted(r.html.split()[0] for r in df.collect()) == ["<p>11111", "<p>19998", "<p>7"]


def test_a_site_reads_its_own_row_groups(spark, laid):
    site = [k for k in range(N) if k % 40 == 3]
    df = fetch_pages(wanted_of(spark, site), laid)
    assert len(site) <= scanned(df) < N / 10
    assert df.filter("html IS NOT NULL").count() == len(site)


def test_bloom_filters_answer_for_absent_urls(spark, laid):
    """Absent URLs that lie between stored ones: only a Bloom filter can tell."""
    absent = spark.createDataFrame([(f"https://h{k:02}.example.org/p{k * 40 + k:06}x", 0, k) for k in range(40)], "norm_url string, depth int, rank long")
    df = laid.filter(url_ranges(absent)).select("page_id", "html")
    assert scanned(df) < N / 20 and df.collect() == []


def test_ranges_hold_for_every_url(spark):
    """Few and many, repeated, null, long and non-ASCII URLs."""
    odd = ["https://a", "https://a/é", "https://z/\U0010ffff", "https://b/" + "x" * (2 * LONGEST_BOUND), "https://b/" + "x" * (2 * LONGEST_BOUND) + "y", "", None]
    many = [f"https://h{i % 17}/p{i}" for i in range(900)]
    for listed in (odd[:3], odd, many, many + odd, [None], []):
        table = spark.createDataFrame([(u,) for u in listed * 2], "norm_url string")
        assert table.filter(url_ranges(table)).count() == 2 * sum(u is not None for u in listed)
    near = spark.createDataFrame([(u,) for u in many], "norm_url string")
    test = url_ranges(near.filter("norm_url LIKE 'https://h3/%'"))
    assert near.filter(test).count() == sum(u.startswith("https://h3/") for u in many)


def test_runs_agree_on_any_layout(spark, tmp_path):
    graph = {"S": ["P1", "L1", "P7"], "L1": ["P2", "P3", "L2"], "L2": ["P4"], "P1": [], "P2": [], "P3": [], "P4": []}
    pages = page_table(spark, graph).withColumn("page_id", F.expr("page_id * 2654435761 % 4294967296"))
    write_clustered(pages, str(tmp_path / "p"))
    laid = read_clustered(spark, str(tmp_path / "p"))
    plain, found = run_bulk(pages, SEED), run_bulk(laid, SEED)
    for name in ("outcomes", "documents", "bundles"):
        a, b = (sorted(map(str, getattr(run, name).drop("page_id").collect())) for run in (plain, found))
        assert a == b and a
    typed = [r.url for r in pages.select("url").limit(5).collect()] + ["https://not.stored/x"]
    a, b = (sorted(map(str, clean_listed(t, typed).collect())) for t in (pages, laid))
    assert a == b and len(a) >= 2
