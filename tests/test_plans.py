"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from pageloom import SiteProfile
from pageloom.functions import urls
from pageloom.operators.bundle import last_writer_wins
from pageloom.operators.clean import clean_pages
from pageloom.operators.crawl import StagedEdges
from pageloom.operators.links import page_links
from pageloom.operators.parse import parse_pages
from pageloom.sources.assets import accept_images, acceptable_images
from pageloom.session import stage
from pageloom.sources.pages import fetch_pages


@pytest.fixture
def pages(spark, testdata):
    return spark.read.parquet(f"{testdata}/pages.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange (\w+\(.*?\)),", plan(df))


def test_url_functions_read_only_the_url(pages):
    text = plan(pages.select("page_id", urls.normalize(F.col("url")).alias("n")))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text and "Exchange" not in text


def test_links_do_not_shuffle_and_parse_reads_three_columns(pages):
    text = plan(page_links(parse_pages(pages), SiteProfile(link_roots=())))
    assert "Exchange" not in text and text.count("MapInArrow") == 1
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in text


def test_cleaning_stays_in_the_page(pages):
    """No shuffle, no sort, no window, no rows per node; two passes through Python."""
    text = plan(clean_pages(parse_pages(pages)))
    assert text.count("MapInArrow") == 1 and text.count("ArrowEvalPython") == 1
    assert not re.search("Exchange|Sort|Window|Generate|Join|Aggregate", text)


def test_embedding_moves_an_image_once(spark, pages):
    """Without any broadcast: contents by their hash, uses by the same, then the pieces of a page; no other shuffle."""
    assets = spark.createDataFrame(
        [("http://i/a", "image/png", 1, bytearray(b"a"))],
        "img_url string, content_type string, content_length long, payload binary")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffles(clean_pages(parse_pages(pages), images=acceptable_images(assets)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(re.findall(r"\((\w+)#", m)[0] for m in moved) == ["asset", "asset", "page_id"]


def test_documents_meet_their_images_as_whole_rows(spark, pages):
    """Only images are unfolded; documents move as they are and nothing is gathered before it has moved."""
    assets = spark.createDataFrame(
        [("http://i/a", "image/png", 1, bytearray(b"a"))],
        "img_url string, content_type string, content_length long, payload binary")
    text = plan(clean_pages(parse_pages(pages), images=acceptable_images(assets)))
    moved = text[text.index("hashpartitioning(page_id"):]
    assert "collect_list" in text and "collect_list" not in moved and text.count("Generate posexplode") == 1


def test_html_is_read_by_ranges_of_page_id(pages):
    """URLs are looked up without html; the html scan gets the chosen ids' ranges."""
    wanted = pages.select(urls.normalize(F.col("url")).alias("norm_url"), F.lit(0).alias("depth"), F.col("page_id").alias("rank"))
    text = plan(fetch_pages(wanted.filter("page_id = 7"), pages))
    scan = next(line for line in text.split("\n") if "html" in line and "FileScan" in line)
    assert "GreaterThanOrEqual(page_id,7)" in scan and "LessThanOrEqual(page_id,7)" in scan
    assert "ReadSchema: struct<page_id:bigint,html:string>" in scan


def test_announced_image_size_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(
        [("http://i/a", "image/png", 1, bytearray(b"a"))],
        "img_url string, content_type string, content_length long, payload binary").write.parquet(str(tmp_path / "a"))
    text = plan(accept_images(spark.read.parquet(str(tmp_path / "a"))))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(content_length,10485760\)", text)


def test_one_document_per_key_is_limited_before_the_shuffle(pages):
    keyed = pages.select("page_id", "html", urls.file_key(F.col("url")).alias("file_key"))
    text = plan(last_writer_wins(keyed, "file_key", "page_id"))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


@pytest.mark.parametrize("hot_rows", [1500, 10])
def test_a_crawl_step_does_not_move_edges(spark, hot_rows):
    """Of the step's join only the frontier is shuffled, also where a hot source is cut into shares."""
    edges = stage(spark.range(2000).selectExpr("if(id % 2 = 0, 'hub', concat('s', id)) AS src", "int(id) AS pos", "concat('d', id) AS dst", "id % 3 = 0 AS is_page"), "edges")
    frontier = stage(spark.createDataFrame([("hub", [1]), ("s7", [2, 3])], "src string, path array<int>"), "frontier")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = StagedEdges.of(edges, hot_rows).leaving(frontier)
        text = plan(links)
        assert sorted(r.dst for r in links.collect()) == sorted(["d7", *(f"d{i}" for i in range(0, 2000, 2))])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    join = text[text.index("SortMergeJoin"):]
    edge_side = join[: join.index("Exchange")]
    assert "edges_by_src" in edge_side and "Bucketed: true" in edge_side
