"""One query per operator (or small group of operators), each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import shapes
from pageloom import CleanRules, SiteProfile
from pageloom.functions import dom, urls
from pageloom.functions.bind import bind
from pageloom.operators import bundle, images
from pageloom.operators.clean import clean_pages, clean_pieces, with_content
from pageloom.operators.crawl import crawl
from pageloom.operators.links import link_edges, page_links, with_norm_url
from pageloom.operators.parse import node_table, parse_pages
from pageloom.plans.runs import clean_typed, run_bulk
from pageloom.plans.store import RunStore
from pageloom.session import stage, stage_folder
from pageloom.sources import assets, layout, sinks
from pageloom.sources.pages import fetch_pages, read_pages, resolve_attempts, spread_pages
from pageloom.streaming.arrivals import PageStream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WHOLE_PAGE = SiteProfile(link_roots=())
ARTICLE = CleanRules(roots=(("article", None, None),))


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_pages(spark, sf_dir):
    return spread_pages(read_pages(spark, f"{sf_dir}/pages.parquet"))


def derived_pages(spark, sf_dir, html):
    """One page per document."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit(f"{shapes.SITE}/d/"), F.col("doc_id").cast("string"))
    return spread_pages(docs.select(F.col("doc_id").alias("page_id"), url.alias("url"), F.expr(html).alias("html")))


# ---- URLs ------------------------------------------------------------------


@query
def url_split(spark, sf_dir):
    """U3"""
    return table(spark, sf_dir, "pages").select("page_id", urls.split_url(F.col("url")).alias("p")).select("page_id", "p.*")


@query
def url_ensure_scheme(spark, sf_dir):
    """U1, U2"""
    typed = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '  ' || substr(url, instr(url, '//') + 2) ELSE ' ' END")
    domains = SiteProfile(domains=("spam-farm.example.org", "www.cheap-pills.example.com"))
    full = urls.ensure_scheme(typed)
    return table(spark, sf_dir, "pages").select(
        "page_id", full.alias("full_url"), urls.allowed_domain(F.upper(full), domains).alias("allowed")
    )


@query
def url_normalize(spark, sf_dir):
    """U5"""
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm_url"))


@query
def url_dedupe(spark, sf_dir):
    """min() combines before the shuffle"""
    normed = with_norm_url(table(spark, sf_dir, "pages").select("page_id", "url"))
    return normed.groupBy("norm_url").agg(F.min("page_id").alias("first_page"))


@query
def url_resolve(spark, sf_dir):
    """U4"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(shapes.HREF).alias("href"))
    page_url = F.concat(F.lit("https://h.example.com:80/deep/page"), F.col("doc_id"), F.lit("/?x=1"))
    parts = bind(docs, **urls.link_parts(F.col("href")), base_scheme=urls.scheme(page_url), base_netloc=urls.netloc(page_url))
    joined = urls.join_parts(*[F.col(c) for c in ("link", "own", "rest", "base_scheme", "base_netloc")])
    return parts.select("doc_id", joined.alias("abs_url"))


@query
def url_file_key(spark, sf_dir):
    """U17"""
    return table(spark, sf_dir, "pages").select("page_id", urls.file_key(F.col("url")).alias("file_key"))


@query
def url_keyword_reject(spark, sf_dir):
    """U10, U11"""
    url, profile = F.col("url"), SiteProfile()
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.page_keyword_rejected(url, profile).alias("page_rejected"),
        urls.listing_keyword_rejected(url, profile).alias("listing_rejected"),
    )


@query
def url_rules(spark, sf_dir):
    """U7, U8, U9, U12 one by one"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(shapes.CANDIDATE).alias("url"))
    url, profile = F.col("url"), SiteProfile()
    return docs.select(
        "doc_id",
        urls.site_url(url, profile).alias("on_site"),
        urls.is_listing_itself(url, F.lit(shapes.CLASSIFY_SEED)).alias("is_seed"),
        urls.excluded(url, profile).alias("excluded"),
        urls.page_slug(url, profile).alias("page_slug"),
    )


@query
def url_classify(spark, sf_dir):
    """U15, U16"""
    docs = bind(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), link=F.expr(shapes.CANDIDATE))
    seed, keywords = F.lit(shapes.CLASSIFY_SEED), urls.keyword_list(spark, shapes.CLASSIFY_SEED)
    return docs.select(
        "doc_id",
        urls.is_wanted_page(F.col("link"), seed, keywords=keywords).alias("wanted"),
        urls.is_listing(F.col("link"), seed, keywords=keywords).alias("listing"),
    )


@query
def subject_keywords(spark, sf_dir):
    """U13"""
    keywords = urls.subject_keywords(F.expr(shapes.LISTING_URL))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(keywords, "|").alias("keywords"))


@query
def on_topic(spark, sf_dir):
    """U14, with keywords of each row's own"""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("'https://h.example.com/' || source || '-' || lang || '-networks/x?y=terms'").alias("url"),
        F.expr("""CASE doc_id % 4 WHEN 0 THEN array(source, 'ens', 'none', 'terms') WHEN 1 THEN array('zz', 'des', 'yy')
                  WHEN 2 THEN array('s', 'networks', 'ww', 'vv') ELSE array('network', 'src1s', 'qq', 'ww', 'zz') END""").alias("k"),
    )
    return docs.select("doc_id", urls.on_topic(F.col("url"), F.col("k")).alias("on_topic"))


# ---- pages and links -------------------------------------------------------


@query
def html_nodes(spark, sf_dir):
    """H1: elements per page and tag"""
    nodes = node_table(parse_pages(stored_pages(spark, sf_dir)))
    return nodes.filter("kind = 'element'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query
def title_challenge(spark, sf_dir):
    """H6, S2"""
    pages = stored_pages(spark, sf_dir).withColumn("html", F.expr(shapes.BROKEN_HTML))
    return with_content(parse_pages(pages)).select("page_id", "title", "status")


@query
def links_all(spark, sf_dir):
    """H4 over whole pages"""
    links = page_links(parse_pages(stored_pages(spark, sf_dir)), WHOLE_PAGE)
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query
def links_rooted(spark, sf_dir):
    """H2: links of the content root, whichever selector finds it"""
    html = shapes.ROOTED_HTML.replace("inner_html", shapes.INNER_HTML)
    links = page_links(parse_pages(derived_pages(spark, sf_dir, html)))
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), "abs_url")


@query
def links_resolved(spark, sf_dir):
    """H4, U4, U5"""
    links = page_links(parse_pages(stored_pages(spark, sf_dir)), WHOLE_PAGE)
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"), "abs_url",
                        urls.normalize(F.col("abs_url")).alias("norm_url"))


@query
def links_by_host(spark, sf_dir):
    """H4, U3, A1; the distinct count goes by (host, href) first, so one large host is spread"""
    links = page_links(parse_pages(stored_pages(spark, sf_dir)), WHOLE_PAGE)
    return links.select(urls.netloc(F.col("url")).alias("host"), "href").groupBy("host").agg(
        F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct")
    )


@query
def text_article(spark, sf_dir):
    """H1, H3, C16 before cleaning; no shuffle"""
    pages = with_content(parse_pages(stored_pages(spark, sf_dir)))
    return pages.select("page_id", dom.page_text(F.col("nodes"), strip_pieces=False).alias("text"))


@query
def math_flag(spark, sf_dir):
    """H5"""
    pages = stored_pages(spark, sf_dir).withColumn("html", F.expr(shapes.MATH_HTML))
    return parse_pages(pages).select("page_id", dom.has_math(F.col("nodes")).alias("has_mathjax"))


# ---- cleaning --------------------------------------------------------------


@query
def clean_root(spark, sf_dir):
    """The container is picked by the cleaning chain"""
    html = shapes.ROOTED_HTML.replace("inner_html", "'<p id=p>k' || doc_id || '</p>'")
    return clean_pages(parse_pages(derived_pages(spark, sf_dir, html)), standalone=False).select("page_id", "clean_html")


@query
def clean_derived(spark, sf_dir):
    """Every removal rule"""
    cleaned = clean_pages(parse_pages(derived_pages(spark, sf_dir, shapes.DIRTY_HTML)), standalone=False)
    return cleaned.select("page_id", "title", "status", "clean_html", "clean_text")


@query
def clean_article(spark, sf_dir):
    """All stored pages, unvalidated, as fragments"""
    return clean_pages(parse_pages(stored_pages(spark, sf_dir)), standalone=False).select("page_id", "file_key", "clean_html")


@query
def clean_document(spark, sf_dir):
    """C14, C17: standalone documents, with and without math"""
    pages = stored_pages(spark, sf_dir).withColumn("html", F.expr(shapes.MATH_HTML))
    return clean_pages(parse_pages(pages), CleanRules(math_hook_src="hook.js")).select("page_id", "clean_html")


@query
def text_body_clean(spark, sf_dir):
    """C4-C11 from the body down, with one more class to remove"""
    rules = CleanRules(roots=(("body", None, None),), removed_classes=(*CleanRules().removed_classes, "ad"))
    return clean_pages(parse_pages(stored_pages(spark, sf_dir)), rules).select("page_id", "clean_text")


# ---- images ----------------------------------------------------------------


def image_assets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(shapes.IMAGE_HOST), F.col("doc_id").cast("string")).alias("img_url"),
        F.expr(shapes.IMAGE_TYPE).alias("content_type"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN n_chars + 1000 ELSE n_chars END").alias("content_length"),
        F.encode("text", "UTF-8").alias("payload"),
    )


def image_pages(spark, sf_dir):
    return derived_pages(spark, sf_dir, shapes.IMAGE_HTML)


@query
def image_accept(spark, sf_dir):
    """S4, I3, I4, I5"""
    accepted = assets.accept_images(image_assets(spark, sf_dir), limit=shapes.IMAGE_LIMIT)
    return accepted.select("img_url", "data_uri")


@query
def image_accept_lenient(spark, sf_dir):
    """I6"""
    accepted = assets.accept_images(image_assets(spark, sf_dir), strict=False)
    return accepted.select("img_url", F.md5("data_uri").alias("uri_md5"))


@query
def image_files(spark, sf_dir):
    """A file per image, written by tasks and read back as assets"""
    path = f"{stage_folder(spark)}/images-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    assets.write_image_files(docs.select(F.expr(shapes.IMAGE_FILE).alias("name"), F.encode("text", "UTF-8").alias("payload")), path)
    stored = assets.read_image_files(spark, path, shapes.FILE_TYPES, shapes.IMAGE_HOST, shapes.IMAGE_LIMIT)
    return assets.accept_images(stored, limit=shapes.IMAGE_LIMIT).select("img_url", F.md5("data_uri").alias("uri_md5"))


@query
def image_refs(spark, sf_dir):
    """H7"""
    return images.image_refs(with_content(parse_pages(image_pages(spark, sf_dir)))).select("page_id", "img_url")


@query
def image_embed(spark, sf_dir):
    """References joined to accepted assets"""
    refs = stage(images.image_refs(with_content(parse_pages(image_pages(spark, sf_dir)))), "refs")
    accepted = assets.acceptable_images(image_assets(spark, sf_dir), limit=shapes.IMAGE_LIMIT)
    return images.embed_refs(refs, accepted).select("page_id", "img_url", F.md5("data_uri").alias("uri_md5"))


@query
def image_clean(spark, sf_dir):
    """C2, C3, I1, I2 within cleaning"""
    accepted = assets.acceptable_images(image_assets(spark, sf_dir), limit=shapes.IMAGE_LIMIT)
    cleaned = clean_pages(parse_pages(image_pages(spark, sf_dir)), images=accepted, standalone=False)
    return cleaned.select("page_id", F.md5("clean_html").alias("html_md5"), F.length("clean_html").cast("bigint").alias("n_chars"))


@query
def image_pieces(spark, sf_dir):
    """Documents in ordered pieces, contents kept once by their hash; no row holds two images"""
    accepted = assets.acceptable_images(image_assets(spark, sf_dir), limit=shapes.IMAGE_LIMIT)
    pieces = clean_pieces(parse_pages(image_pages(spark, sf_dir)), accepted, standalone=False).pieces()
    return pieces.select("page_id", F.col("piece").cast("bigint").alias("piece"), F.md5("markup").alias("markup_md5"))


# ---- crawl and whole runs --------------------------------------------------


def fan_out(documents: int) -> int:
    """Smallest tree degree that reaches every document within the crawl's depth."""
    degree = 1
    while sum(degree**d for d in range(4)) < documents:
        degree += 1
    return degree


def site_pages(spark, sf_dir, more="''"):
    """A site of the documents: listing i links to its children in a heap-shaped tree, to
    page i (in three spellings), to the seed and to links nobody wants. Page i holds the
    text and ``more``; every tenth page is stored under an address no link has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    degree = fan_out(n)
    first, last = f"(doc_id * {degree} + 1)", f"least(doc_id * {degree} + {degree}, {n} - 1)"
    children = f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE array() END"
    page = "'/stack-questions-answers-p' || doc_id"
    links = f"""array_join(transform({children}, c -> '<a href="/stack-section-' || c || '/">s</a>'), '')
      || '<a href="' || {page} || '/">p</a><a href="' || {page} || '?x=1">p</a><a href="{shapes.SITE}' || {page} || '#f">p</a>'
      || '<a href="{shapes.SEED}">home</a><a href="/java-questions-answers-x">off</a><a href="/about-stack-mcq-x">no</a>
          <a href="/stack-mcq-x/?utm_source=feed">listing nobody stored</a>'"""
    listing_url = f"CASE WHEN doc_id = 0 THEN '{shapes.SEED}' ELSE '{shapes.SITE}/stack-section-' || doc_id || '/?v=1' END"
    body = f"""'<div class="entry-content"><h1>Doc ' || doc_id || '</h1><p>' || {shapes.ESCAPED_TEXT}
      || '</p>' || {more} || '<div class="sf-mobile-ads">ad</div><p>To practice all</p></div>'"""
    moved = "CASE WHEN doc_id % 10 = 7 THEN '-moved' ELSE '' END"
    listing = F.struct(
        (F.col("doc_id") * 2).alias("page_id"), F.expr(listing_url).alias("url"),
        F.expr(f"""'<div class="entry-content">' || {links} || '</div><a href="/stack-mcq-outside">x</a>'""").alias("html"),
    )
    stored = F.struct(
        (F.col("doc_id") * 2 + 1).alias("page_id"),
        F.expr(f"'http://{shapes.HOST}' || {page} || {moved}").alias("url"), F.expr(body).alias("html"),
    )
    # Both from one row: files of short listings alone would give a few tasks half of all URLs.
    return spread_pages(stage(docs.select(F.inline(F.array(listing, stored))), "site"))


@query
def link_edge_table(spark, sf_dir):
    """G1"""
    edges, _ = link_edges(site_pages(spark, sf_dir), shapes.SEED)
    return edges.groupBy("src", "is_page").agg(F.count("*").alias("n_links"), F.countDistinct("dst").alias("n_targets"))


@query
def crawl_bounded(spark, sf_dir):
    """G2-G5"""
    found = crawl(site_pages(spark, sf_dir), shapes.SEED).pages
    return found.select("norm_url", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"))


@query
def crawl_listings(spark, sf_dir):
    """Every listing is read once, stored or not"""
    listings = crawl(site_pages(spark, sf_dir), shapes.SEED).listings
    return listings.select("norm_url", F.col("depth").cast("bigint").alias("depth"), "fetched")


@query
def fetch_by_url(spark, sf_dir):
    """Wanted URLs left joined to stored pages"""
    wanted = table(spark, sf_dir, "documents").select(
        F.expr(f"'{shapes.SITE}/stack-questions-answers-p' || doc_id").alias("norm_url"),
        F.lit(0).alias("depth"), (F.col("doc_id") + 1).alias("rank"),
    )
    fetched = fetch_pages(wanted, site_pages(spark, sf_dir))
    return fetched.select("url", "page_id", F.md5("html").alias("html_md5"))


def clustered(pages):
    path = f"{stage_folder(pages.sparkSession)}/clustered-{uuid.uuid4().hex}"
    layout.write_clustered(pages, path)
    return layout.read_clustered(pages.sparkSession, path)


@query
def fetch_clustered(spark, sf_dir):
    """Pages with shuffled ids, laid out by URL, then every address looked up; every fifth also one that is not stored"""
    pages = stored_pages(spark, sf_dir).withColumn("page_id", F.expr(shapes.SHUFFLED_ID))
    asked = pages.select(urls.normalize(F.col("url")).alias("norm_url"), F.col("page_id").alias("rank"))
    absent = asked.filter("rank % 5 = 0").select(F.concat("norm_url", F.lit("/absent")).alias("norm_url"), "rank")
    wanted = asked.unionByName(absent).groupBy("norm_url").agg(F.min("rank").alias("rank")).withColumn("depth", F.lit(0))
    return fetch_pages(wanted, clustered(pages)).select("url", "page_id", "rank", F.md5("html").alias("html_md5"))


@query
def crawl_clustered(spark, sf_dir):
    """G1, G2 over pages laid out by URL"""
    found = crawl(clustered(site_pages(spark, sf_dir)), shapes.SEED).pages
    return found.select("norm_url", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"))


@query
def fetch_snapshots(spark, sf_dir):
    """Three stored pages per address, some empty, missing or a challenge; the first valid one is read"""
    pages = stored_pages(spark, sf_dir)
    versions = pages.withColumn("v", F.explode(F.array(*[F.lit(v) for v in range(3)]))).select(
        (F.col("page_id") * 3 + F.col("v")).alias("page_id"), "url", F.expr(shapes.VERSION_HTML).alias("html"))
    wanted = pages.select(urls.normalize(F.col("url")).alias("norm_url")).distinct().select("norm_url", F.lit(0).alias("depth"), F.lit(1).alias("rank"))
    return fetch_pages(wanted, versions).select("url", "page_id", F.md5("html").alias("html_md5"))


@query
def stream_documents(spark, sf_dir):
    """S2, H1, C17, A7 as a stream: three stored pages per address arrive as files, in four batches; the first valid one is cleaned"""
    folder = f"{stage_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    versions = stored_pages(spark, sf_dir).withColumn("v", F.explode(F.array(*[F.lit(v) for v in range(3)]))).select(
        (F.col("page_id") * 3 + F.col("v")).alias("page_id"), "url", F.expr(shapes.VERSION_HTML).alias("html"))
    # The pages of one address arrive together, so that which of them counts does not hang on the order of files.
    bind(versions, norm_url=urls.normalize(F.col("url"))).repartition("norm_url").drop("norm_url").write.parquet(f"{folder}/in")
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    arriving = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{folder}/in")
    stream = PageStream(spark, f"{folder}/out", ARTICLE)
    stream.start(arriving).awaitTermination()
    return stream.documents().select(F.col("norm_url").alias("url"), "page_id", "file_key", "status", F.md5("clean_text").alias("text_md5"))


@query
def single_pages(spark, sf_dir):
    """URLs as typed, stored or not"""
    pages = stored_pages(spark, sf_dir)
    typed = pages.select(F.expr(shapes.TYPED_URL).alias("url"), F.col("page_id").alias("rank"))
    return clean_typed(pages, typed).select("rank", "url", "file_key", "page_id", "status")


@query
def bulk_outcomes(spark, sf_dir):
    """One row per wanted page"""
    outcomes = run_bulk(site_pages(spark, sf_dir), shapes.SEED).outcomes
    return outcomes.select("file_key", "status", "rank", "clean_text")


@query
def bulk_bundles(spark, sf_dir):
    """The subject's documents in crawl order, in parts"""
    bundles = run_bulk(site_pages(spark, sf_dir), shapes.SEED).bundles
    return bundles.select("subject", "part", "n_docs", F.md5("body").alias("body_md5"))


@query
def bulk_with_images(spark, sf_dir):
    """A run that embeds or drops every image"""
    pages = site_pages(spark, sf_dir, f"""'<p><img src="' || {shapes.FIRST_IMAGE} || '"></p>'""")
    accepted = assets.acceptable_images(image_assets(spark, sf_dir), limit=shapes.IMAGE_LIMIT)
    return run_bulk(pages, shapes.SEED, images=accepted).documents.select("file_key", F.md5("clean_html").alias("html_md5"))


@query
def bulk_failed(spark, sf_dir):
    """A7 with S3, U1, A3, A4: a seed without scheme, tries to get each page, what failed, the bundle's name"""
    attempts = table(spark, sf_dir, "documents").select(
        F.expr(f"'{shapes.SITE}/stack-questions-answers-p' || doc_id").alias("url"),
        F.posexplode(F.expr(shapes.OUTCOMES)).alias("attempt", "outcome"),
    )
    run = run_bulk(site_pages(spark, sf_dir), f" {shapes.SEED.removeprefix('https://')}", attempts=attempts,
                   run_time=datetime(2024, 1, 2, 3, 4, 5))
    return run.failed.withColumn("bundle_name", F.lit(run.name))


@query
def bulk_counts(spark, sf_dir):
    """A1: the counts of a run, gathered while its outcomes are written"""
    counts = run_bulk(site_pages(spark, sf_dir), shapes.SEED).counts
    return spark.createDataFrame(sorted(counts.items()), "status string, n long")


@query
def incremental_runs(spark, sf_dir):
    """A run over the pages of even ids, then one over all that leaves out what is done; the documents of both"""
    pages = site_pages(spark, sf_dir)
    store = RunStore(spark, f"{stage_folder(spark)}/store-{uuid.uuid4().hex}")
    store.add(pages.filter("page_id % 2 = 0 OR page_id % 4 = 1"), shapes.SEED)
    store.add(pages, shapes.SEED)
    return store.documents().select("file_key", F.col("run").cast("bigint").alias("run"), "rank", F.md5("clean_html").alias("html_md5"))


@query
def empty_run(spark, sf_dir):
    """A5: a run over all stored pages from a listing nobody stored gives empty tables of the usual columns"""
    pages = stored_pages(spark, sf_dir)
    run = run_bulk(pages, shapes.SEED)
    tables = {"pages": pages, "outcomes": run.outcomes, "documents": run.documents, "bundles": run.bundles, "failed": run.failed}
    counted = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(",".join(df.columns)).alias("fields"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


# ---- outcomes, keys and bundles --------------------------------------------


@query
def retry_status(spark, sf_dir):
    """S3: at most three attempts, the first that is no error is final"""
    outcome = F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'rejected' ELSE 'ok' END")
    return resolve_attempts(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], outcome)


@query
def run_statistics(spark, sf_dir):
    """A1"""
    pages = stored_pages(spark, sf_dir).withColumn("html", F.expr(shapes.BROKEN_HTML))
    return bundle.run_statistics(with_content(parse_pages(pages)))


@query
def failed_members(spark, sf_dir):
    """A3: as rows, however many"""
    pages = stored_pages(spark, sf_dir).withColumn("html", F.expr(shapes.BROKEN_HTML))
    outcomes = with_content(parse_pages(pages)).withColumn("file_key", urls.file_key(F.col("url")))
    return bundle.failed_members(outcomes)


@query
def sink_last_wins(spark, sf_dir):
    """S6"""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urls.file_key(F.col("url")).alias("file_key"))
    return bundle.last_writer_wins(pages, "file_key", "page_id")


@query
def bundle_by_key(spark, sf_dir):
    """A2: the article texts per file key, in page order"""
    docs = clean_pages(parse_pages(stored_pages(spark, sf_dir)), ARTICLE)
    parts = bundle.bundle_parts(docs, "file_key", "page_id", "clean_text")
    return parts.select("file_key", "part", "n_docs", F.md5("body").alias("body_md5"))


@query
def bundle_offsets(spark, sf_dir):
    """Bundles of any size, written as members with an index of 64-bit offsets and read back"""
    path = f"{stage_folder(spark)}/indexed-{uuid.uuid4().hex}"
    docs = clean_pages(parse_pages(stored_pages(spark, sf_dir)), ARTICLE)
    sinks.write_indexed(docs, path, "file_key", ["page_id"], "clean_text")
    index, members = (spark.read.parquet(f"{path}/{part}") for part in ("index", "members"))
    return members.join(index, ["file_key", "page_id"]).select(
        "file_key", "page_id", F.col("member").cast("bigint").alias("member"), "start", "length", F.md5("clean_text").alias("text_md5"))


@query
def bulk_members(spark, sf_dir):
    """Where each document of a run lies in the subject's bundle"""
    members = run_bulk(site_pages(spark, sf_dir), shapes.SEED).members()
    return members.select("subject", "member", "start", "length", "file_key")


@query
def bundle_conversations(spark, sf_dir):
    """A2"""
    return bundle.bundle_parts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query
def bundle_names(spark, sf_dir):
    """A4: the time comes with the row"""
    return table(spark, sf_dir, "events").select("event_id", bundle.bundle_name(F.col("ts")).alias("bundle_name"))


@query
def sink_documents(spark, sf_dir):
    """Cleaned documents in a fixed number of folders, read back"""
    path = f"{stage_folder(spark)}/documents-{uuid.uuid4().hex}"
    docs = clean_pages(parse_pages(stored_pages(spark, sf_dir)), ARTICLE)
    sinks.write_documents(docs.select("page_id", "file_key", "clean_text"), path, subject="file_key", folders=16)
    written = sinks.read_written(spark, path, "page_id long, clean_text string, file_key string")
    return written.select("page_id", "file_key", F.md5("clean_text").alias("text_md5"))


@query
def merge_documents(spark, sf_dir):
    """A2 over what the document sink holds: written, read back, the last per key, one bundle"""
    path = f"{stage_folder(spark)}/documents-{uuid.uuid4().hex}"
    docs = clean_pages(parse_pages(stored_pages(spark, sf_dir)), ARTICLE)
    docs = docs.withColumn("file_key", F.concat_ws("-", "file_key", F.col("page_id") % 50))
    sinks.write_documents(docs.select("page_id", "file_key", "clean_text"), path)
    written = sinks.read_written(spark, path, "page_id long, file_key string, clean_text string")
    parts = bundle.merged(bundle.last_writer_wins(written, order="page_id"), ["file_key"], "clean_text", "merged")
    return parts.select("subject", "part", "n_docs", F.md5("body").alias("body_md5"))


@query
def sink_bundles(spark, sf_dir):
    """Bundles in parts, in a fixed number of folders, read back"""
    path = f"{stage_folder(spark)}/bundles-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urls.file_key(F.col("url")).alias("file_key"))
    sinks.write_bundles(bundle.bundle_parts(pages, "file_key", "page_id", "url"), path, "file_key", folders=16)
    written = sinks.read_written(spark, path, "part long, n_docs long, body string, file_key string")
    return written.select("file_key", "part", "n_docs", "body")
