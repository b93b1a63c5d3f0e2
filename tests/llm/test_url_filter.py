"""URL filters against a plain version, on the smallest pages and on awkward URLs."""

import re
from collections import Counter

import pytest

from pageloom.llm import bloom as blocked
from pageloom.llm import queries, url_filter

URLS = [
    None, "", "no scheme/at all", "://", "http://", "http://ORG/", "http://a.org", "HTTP://A.Example.ORG/es/x?q=1#f", "https://example.org/en/12",
    "https://example.org/en/2", "https://notexample.org/es/", "ftp://x.com/fr/", "ftp://x.com/de", "ftp://x.com/de/ä ö", "http://x.com:80/en//", "http://x.com/en?utm_source=a",
    "http://x.com/en?b=2&a=1&ref=z", "https://x.com/en/?a=1&&b=2#top", "http://y.net?x=://org/", "http://y.net/a\nb/", "http://" + "l" * 200_000 + ".net/" + "p" * 200_000,
    "http://com/fr/", "http://x.com/en/", "http://x.com/en/",
]
LISTED = ["https://X.com/en", None, "nothing", "http://x.com/en?a=1&b=2", "https://x.com/en", "https://y.net/a\nb"]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(host) :])[0]
    asked = re.match(r"[^?#]*\?([^#]*)", rest)
    kept = sorted(p for p in (asked[1].split("&") if asked else []) if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|\Z)", p))
    return host, path, re.sub(r":(80|443)\Z", "", host) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain_verdicts(rows, listed, rules):
    known = {plain_parts(u)[2] for u in listed} - {None}
    for i, url in rows:
        host, path, canonical = plain_parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        hit = canonical in known
        yield i, host, path, best and best.name, best.verdict if best else ("block" if hit else "allow"), hit


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i != 3 else None, u, "clash", "clash") for i, u in enumerate(URLS)] + [(1, URLS[7], "", "")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, listed string").repartition(3)


@pytest.mark.parametrize("max_blocks, hot_rows", [(blocked.MAX_BLOCKS, 1_000_000), (1, 1)])
def test_judge(spark, pages, max_blocks, hot_rows):
    """Also with a filter of one block, and with every URL taken for a hot key."""
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    got = Counter(tuple(r) for r in url_filter.judge(pages, listed, queries.URL_RULES, max_blocks=max_blocks, hot_rows=hot_rows).collect())
    rows = [(r["page_id"], r["url"]) for r in pages.collect()]
    assert got == Counter(plain_verdicts(rows, LISTED, queries.URL_RULES))


def test_empty_tables(spark, pages):
    none = spark.createDataFrame([], "url string")
    assert url_filter.judge(pages.limit(0), pages, queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, none).collect()} == {"allow"}


def test_filter_passes_every_listed_url_and_few_others(spark):
    """At full strength at most one in a hundred unlisted URLs takes the join."""
    listed = spark.range(20_000).selectExpr("concat('h', id, '.net/x') AS canonical")
    others = spark.range(20_000).selectExpr("concat('h', id, '.net/y') AS canonical")
    n_blocks = blocked.blocks_for(20_000)
    bloom = blocked.bloom_filter(listed, "canonical", n_blocks)
    assert bloom.count() <= n_blocks <= blocked.MAX_BLOCKS
    assert blocked.possible(listed, "canonical", bloom, n_blocks).filter("NOT possible").count() == 0
    assert blocked.possible(others, "canonical", bloom, n_blocks).filter("possible").count() < 200
    assert blocked.blocks_for(10**9) == blocked.MAX_BLOCKS
