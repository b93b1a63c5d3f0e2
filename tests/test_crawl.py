"""Walks over small link graphs: S the seed, L listings, P wanted pages."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pageloom import SiteProfile
from pageloom.functions import urls
from pageloom.operators import links
from pageloom.operators.crawl import crawl
from pageloom.operators.links import id_ranges
from pageloom.operators.parse import parse_pages
from pageloom.plans.runs import clean_listed, run_bulk
from pageloom.profile import DOMAINS
from pageloom.sources.pages import fetch_pages

SITE = f"https://{DOMAINS[1]}"
SEED = f"{SITE}/1000-stack-questions-answers/"


def url(name):
    if name == "S":
        return SEED
    return f"{SITE}/stack-questions-answers-{name.lower()}/" if name[0] == "P" else f"{SITE}/stack-{name.lower()}/"


def page_table(spark, graph, lost=()):
    rows = []
    for i, (source, targets) in enumerate(graph.items()):
        if source in lost:
            continue
        links = "".join(f'<a href="{t if t.startswith("http") else url(t)}">x</a>' for t in targets)
        rows.append((i, url(source), f'<div class="entry-content"><p>{source}</p>{links}</div><a href="{url("P99")}">no</a>'))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def walk(graph, lost=(), max_depth=3):
    """Plain breadth-first search; pages in order of discovery."""
    level, crawled, found = ["S"], {"S"}, {}
    for depth in range(max_depth + 1):
        after = []
        for source in level:
            for target in [] if source in lost else graph.get(source, []):
                if target[0] == "P":
                    found.setdefault(target, depth)
                elif target not in crawled and depth < max_depth:
                    crawled.add(target)
                    after.append(target)
        level = after
    return found


def names(rows):
    """Wanted pages of a result, in rank order, with depth."""
    rows = sorted(rows, key=lambda r: r.rank)
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    return [("P" + r.norm_url.rsplit("-p", 1)[1], r.depth) for r in rows]


GRAPHS = {
    "depth bound": {"S": ["L1"], "L1": ["L2", "P1"], "L2": ["L3", "P2"], "L3": ["L4", "P3"], "L4": ["P4"]},
    "shortest path counts": {"S": ["L1", "L3"], "L1": ["L2"], "L2": ["L3"], "L3": ["L4"], "L4": ["P1"]},
    "cycles": {"S": ["L1", "P1"], "L1": ["S", "L1", "P1"]},
    "wanted pages are leaves": {"S": ["P1"], "P1": ["P2"]},
    "nothing": {"S": []},
}


@pytest.mark.parametrize("name", GRAPHS)
def test_graphs(spark, name):
    graph = GRAPHS[name]
    assert names(crawl(page_table(spark, graph), SEED).pages.collect()) == list(walk(graph).items())


def test_missing_listing_and_missing_seed(spark):
    graph = {"S": ["L1", "P1"], "L1": ["P2"]}
    result = crawl(page_table(spark, graph, lost=("L1",)), SEED)
    assert names(result.pages.collect()) == [("P1", 0)]
    assert {(r.depth, r.fetched) for r in result.listings.collect()} == {(0, True), (1, False)}
    nothing = crawl(page_table(spark, graph, lost=("S",)), SEED)
    assert nothing.pages.collect() == [] and nothing.pages.columns == ["norm_url", "depth", "rank"]


def test_variants_of_one_url_are_one_page(spark):
    target = url("P1").rstrip("/")
    graph = {"S": [f"{target}?x=1", f"{target}#f", f"{target}/"]}
    assert names(crawl(page_table(spark, graph), SEED).pages.collect()) == [("P1", 0)]


def test_the_first_snapshot_of_a_page_is_read(spark):
    pages = page_table(spark, {"S": ["P1"]})
    copies = spark.createDataFrame(
        [(100 + i, SEED + "?copy", f'<article><a href="{url("P2")}">x</a></article>') for i in range(40)], pages.schema
    )
    assert names(crawl(copies.unionByName(pages), SEED).pages.collect()) == [("P1", 0)]


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_random_graph(spark, hot_rows):
    """Against the plain search; with small ``hot_rows`` the hub's links are salted."""
    rng = random.Random(5)
    listings = ["S"] + [f"L{i}" for i in range(30)]
    graph = {s: [rng.choice("LP") + str(rng.randrange(60)) for _ in range(rng.randrange(4))] for s in listings}
    graph["S"] = ["L0", "L1"] + [f"P{i}" for i in range(60, 100)]
    lost = ("L1",)
    pages = page_table(spark, graph, lost)
    want = list(walk(graph, lost).items())
    for spread in (1, 16):
        got = crawl(pages.repartition(spread), SEED, hot_rows=hot_rows)
        assert names(got.pages.collect()) == want


def test_html_is_read_of_what_is_crawled(spark, monkeypatch):
    """URLs that look like pages are read as listings where a link says so, which goes on for several rounds, and not otherwise."""
    seen = []

    def counted(html, **how):
        seen.extend(r.url for r in html.select("url").collect())
        return parse_pages(html, **how)

    monkeypatch.setattr(links, "parse_pages", counted)
    feed = [f"{SITE}/stack-mcq-{i}/?utm_source=feed" for i in range(3)]
    pages = page_table(spark, {"S": ["P1", feed[0]], "P1": ["P8"], "P2": ["P9"]})
    chain = spark.createDataFrame([(100 + i, f"{SITE}/stack-mcq-{i}/", f'<article><a href="{feed[(i + 1) % 3]}">x</a><a href="{url(f"P{20 + i}")}">x</a></article>')
                                   for i in range(3)], pages.schema)
    result = crawl(pages.unionByName(chain), SEED)
    assert names(result.pages.collect()) == [("P1", 0), ("P20", 1), ("P21", 2), ("P22", 3)]
    assert sorted(r.depth for r in result.listings.filter("fetched").collect()) == [0, 1, 2, 3]
    assert sorted(seen) == sorted([SEED.rstrip("/")] + [f"{SITE}/stack-mcq-{i}" for i in range(3)])


def test_whole_run(spark):
    graph = {"S": ["P1", "L1", "P7"], "L1": ["P2"], "P1": [], "P2": []}
    pages = page_table(spark, graph)
    result = run_bulk(pages, SEED, width=2)
    status = {r.file_key: r.status for r in result.outcomes.collect()}
    key = "stack-questions-answers-p{}".format
    assert status == {key(1): "ok", key(2): "ok", key(7): "missing"}
    assert [r.file_key for r in result.documents.orderBy("rank").collect()] == [key(1), key(2)]
    parts = result.bundles.orderBy("part").collect()
    assert [(r.subject, r.part, r.n_docs) for r in parts] == [("stack", 0, 1), ("stack", 1, 1)]
    assert "<p>P1</p>" in parts[0].body and "<p>P2</p>" in parts[1].body
    members = result.members().orderBy("member").collect()
    assert [(r.member, r.start, r.file_key) for r in members] == [(1, 0, key(1)), (2, members[0].length + 1, key(2))]


def test_a_page_is_a_document_or_failed(spark):
    """Nobody is in the bundle and on the failed list; a page whose title only looks like a challenge is a document."""
    pages = page_table(spark, {"S": ["P1", "P2", "P3", "P4", "P7"], "P1": [], "P2": [], "P3": [], "P4": []})
    html = (F.when(F.col("url").contains("-p2"), "<title>Just a moment of inertia</title><div class='entry-content'><p>hello</p></div>")
            .when(F.col("url").contains("-p3"), "<title>Just a moment...</title>").when(F.col("url").contains("-p4"), None).otherwise(F.col("html")))
    run = run_bulk(pages.withColumn("html", html), SEED)
    made, failed = ({r.file_key for r in df.collect()} for df in (run.documents, run.failed))
    key = "stack-questions-answers-p{}".format
    assert made == {key(1), key(2)} and failed == {key(3), key(4), key(7)}
    assert {r.file_key: r.status for r in run.outcomes.collect()}[key(2)] == "challenge"
    assert made | failed == {r.file_key for r in run.outcomes.collect()}


def test_single_pages(spark):
    """Listed pages are fetched and named as typed, whatever the site; a fragment is not fetched."""
    other = "https://elsewhere.example.org/c-programming-examples/"
    rows = [(5, other, "<article>a</article>"), (9, other + "?copy", "<article>b</article>"), (7, url("P2"), "<main>c</main>"),
            (8, other, "<article>later</article>"), (3, "https://h.example.org/?p=5", "<article>d</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    asked = [url("P2").replace("https", "http"), f" {url('P2')[8:]}", other, other, other + "?copy", other + "#x",
             "h.example.org/?p=5", " ", "https://not.stored/x"]
    got = sorted((r.rank, r.file_key, r.status, r.clean_text) for r in clean_listed(pages, asked).collect())
    p2 = "stack-questions-answers-p2"
    assert got == [
        (1, p2, "missing", None), (2, p2, "ok", "c"), (3, "c-programming-examples", "ok", "a"),
        (5, "c-programming-examples", "ok", "b"), (6, "c-programming-examples", "ok", "a"),
        (7, "p5", "ok", "d"), (9, "x", "missing", None),
    ]


def test_seed_is_checked(spark):
    pages = page_table(spark, {"S": ["P1"], "P1": []})
    assert names(crawl(pages, f" {SEED.split('//')[1]}").pages.collect()) == [("P1", 0)]
    for seed in ("https://elsewhere.example.org/1000-stack-questions-answers/", "  "):
        with pytest.raises(ValueError):
            run_bulk(pages, seed)


def test_page_id_ranges(spark):
    """The test holds for every id, at the ends of the number range too, and leaves gaps out."""
    ids = spark.createDataFrame([(i,) for i in (-(2**63), -5, 0, 7, 2**40, 2**63 - 1)], "page_id long")
    assert ids.filter(id_ranges(ids)).count() == 6
    near = spark.range(1000).select(F.col("id").alias("page_id"))
    test = id_ranges(near.filter("page_id IN (3, 4, 900)"))
    assert [r.page_id for r in near.filter(test).orderBy("page_id").collect()] == [3, 4, 900]
    assert near.filter(id_ranges(near.filter("false"))).isEmpty()


def test_no_page_is_lost_before_the_join(spark):
    """What is wanted, or a listing, passes the tests on stored URLs too, also with ";" inside; off-site lists work."""
    site = SEED.split("/1000")[0]
    links = [f"{site}{p}" for p in ("/a;b-mcq-c/", "/stack;x-questions-answers-y/", "/stack-mcq-z;p=1", "/b;stack-list/", "/x;stack/", "/stack-a/;q/")]
    rows = spark.createDataFrame([(u,) for u in links], "url string")
    keywords = urls.keyword_list(spark, SEED)
    norm = urls.normalize(F.col("url"))
    parts = (F.col("url"), urls.netloc(F.col("url")), urls.path(F.col("url")))
    judged = rows.select(
        urls.classify(*parts, F.lit(SEED), keywords, SiteProfile()).alias("kind"),
        urls.may_be_wanted(norm, SiteProfile()).alias("page"), urls.may_be_listing(norm, keywords, SiteProfile()).alias("listing"))
    got = judged.collect()
    assert {r.kind for r in got} >= {"page", "listing"}
    assert all(r.page for r in got if r.kind == "page") and all(r.listing for r in got if r.kind == "listing")
    pages = spark.createDataFrame([(1, "https://other.org/p1", "<p>x</p>")], "page_id long, url string, html string")
    wanted = spark.createDataFrame([("https://other.org/p1", 0, 1)], "norm_url string, depth int, rank long")
    assert fetch_pages(wanted, pages).first().page_id == 1
