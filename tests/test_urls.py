from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pageloom import SiteProfile
from pageloom.functions import urls
from pageloom.profile import DOMAINS

SITE = f"https://{DOMAINS[1]}"
BARE = DOMAINS[0]
SEED = f"{SITE}/1000-data-structure-questions-answers/"


def evaluate(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select("*", *columns).collect()


def test_keywords(spark):
    vectors = {
        "/1000-database-management-system-questions-answers/": ["database", "management", "system"],
        "/computer-network-questions-answers/": ["computer", "network"],
        "/operating-system-questions-answers/": ["operating", "system"],
        "/1000-c-questions-answers/": ["c"],
        "/java-mcq-multiple-choice-questions/": ["java"],
        "/500-dbms-interview-questions": ["dbms"],
        "/a/b-c": ["a/b", "c"],
        "/": [],
    }
    rows = evaluate(spark, [(SITE + p,) for p in vectors], "u string", urls.subject_keywords(F.col("u")).alias("k"))
    assert [r.k for r in rows] == list(vectors.values())


def test_on_topic(spark):
    vectors = [
        ("https://h/networks-x", ["computer", "networks", "x"], True),    # 3 // 2 = 1
        ("https://h/zzz", [], True),
        ("https://h/zzz", ["s"], True),                                   # rstrip leaves nothing
        ("https://h/abc?network", ["network"], False),                    # path only
        ("https://h/a", ["a", "a", "b", "c"], True),                      # repeats count twice
        ("https://h/A-X", ["a", "b", "c", "d"], False),
    ]
    rows = evaluate(spark, vectors, "u string, k array<string>, want boolean", urls.on_topic(F.col("u"), F.col("k")).alias("got"))
    assert [r.got for r in rows] == [r.want for r in rows]
    literal = [urls.on_topic(F.lit(u), words).alias(f"c{i}") for i, (u, words, _) in enumerate(vectors)]
    assert list(spark.range(1).select(*literal).first()) == [want for _, _, want in vectors]


def test_normalize(spark):
    vectors = {
        "http://www.h.com/x/?q=1#f": "https://www.h.com/x",
        "HTTP://WWW.Host.com/A//": "https://WWW.Host.com/A",
        "https://h/a;p=1?x": "https://h/a",
        "https://h": "https://h",
        "https://h/%%%?a": "https://h/%%%",
    }
    once = urls.normalize(F.col("u"))
    rows = evaluate(spark, [(u,) for u in vectors], "u string", once.alias("n"), urls.normalize(once).alias("nn"))
    assert [r.n for r in rows] == list(vectors.values())
    assert all(r.n == r.nn for r in rows)


def test_split_and_resolve_agree_with_the_standard_library(spark):
    hrefs = [
        "c/d", "/a b", "../x", "./x/../y", "//o.com/x", "?q=1", "mailto:a@b", "#top", "", " ", "/a/./b/..", "/..",
        "..", "/a/..;p", "c//d//", "https:foo", "HTTPS://H/x/../y", "http://x/y", "/a;b;c?d#e", "x;y/z",
        "javascript:void(0)", "/a\tb", "a:b c", "./", "a/.", "/.", "?", "/x?", "/x#", "x#f", "/a//b/../c", ";x",
        "a/b/../../../c;p?q#f", "//o.com", "foo?x=/../y", " /nbsp ", "1a:b", "a+b:c", "https://h/x?a#b?c",
    ]
    for base in ("https://h", "http://h.org:80"):
        rows = evaluate(
            spark, [(h,) for h in hrefs], "h string",
            urls.resolve(F.col("h"), F.lit(base + "/deep/page/?x#y")).alias("r"), urls.split_url(F.col("h")).alias("s"),
        )
        for row in rows:
            link = row.h.strip()
            want = None if not link or link.startswith("#") else urljoin(base, link)
            assert row.r == want, row.h
            parts = urlparse(row.h)
            if parts.scheme in ("", "http", "https"):
                assert tuple(row.s) == tuple(parts), row.h


def test_classify(spark):
    vectors = [
        ("/data-structure-questions-answers-stacks/", True, True),
        (f"http://{BARE}/data-structure-questions-answers-queue?utm=1#x", True, True),
        ("/data-structures-algorithms/", False, True),
        ("/java-questions-answers-arrays/", False, False),
        ("/best-reference-books-data-structures/", False, False),
        ("/BEST-REFERENCE-BOOKS-data-structures/", False, True),
        ("/c-programming-examples-data/", False, False),
        ("/data-structure-questions-answers-feedback/", False, True),
        ("/data-structure-questions-answers-stacks/?utm_source=feed", False, True),
        ("/about-data-structure-questions-answers-x/", False, False),
        ("/1000-data-structure-questions-answers?x=1", False, False),
        ("https://evil.example.com/data-structure-questions-answers-x/", False, False),
        ("/data-structure-mcq-x\n", True, True),
        ("/data\n-structure-mcq-x", False, False),
        (None, False, False),
        ("https:", False, False),
    ]
    rows = [(u if u is None or u.startswith("http") else SITE + u, p, l) for u, p, l in vectors]
    profile, seed = SiteProfile(), F.lit(SEED)
    got = evaluate(
        spark, rows, "u string, page boolean, listing boolean",
        urls.is_wanted_page(F.col("u"), seed).alias("p"), urls.is_listing(F.col("u"), seed).alias("l"),
        urls.may_be_wanted(urls.normalize(F.col("u")), profile).alias("mp"),
        urls.may_be_listing(urls.normalize(F.col("u")), urls.keyword_list(spark, SEED), profile).alias("ml"),
        urls.classify(F.col("u"), urls.netloc(F.col("u")), urls.path(F.col("u")), seed,
                      urls.keyword_list(spark, SEED), profile).alias("kind"),
    )
    for r in got:
        assert (r.p, r.l) == (r.page, r.listing), r.u
        assert r.kind == ("page" if r.page else "listing" if r.listing else None), r.u
        assert (r.mp or not r.p) and (r.ml or not r.l), r.u   # the scan filter drops nothing that counts


def test_scheme_domain_and_file_key(spark):
    rows = evaluate(
        spark, [(" h.com/x ",), ("http://a",), ("HTTP://a",), ("  ",)], "u string", urls.ensure_scheme(F.col("u")).alias("e")
    )
    assert [r.e for r in rows] == ["https://h.com/x", "http://a", "https://HTTP://a", None]
    rows = evaluate(
        spark, [(f"https://{BARE.upper()}/x",), (f"https://{BARE}:80/x",), (f"https://u@{BARE}/x",), ("x",)], "u string",
        urls.allowed_domain(F.col("u"), SiteProfile()).alias("d"),
    )
    assert [r.d for r in rows] == [True, False, False, False]
    keys = {
        f"{SITE}/c-questions-answers/": "c-questions-answers", "https://x/c-q?x=1&y": "c-qx1y",
        "https://x/": "mcq", "https://x": "mcq", "https://x/für_1.html": "für_1html", "https://x/a/b": "a",
    }
    rows = evaluate(spark, [(u,) for u in keys], "u string", urls.file_key(F.col("u")).alias("k"))
    assert [r.k for r in rows] == list(keys.values())
