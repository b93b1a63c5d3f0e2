"""Runs that add up, leave nothing behind and count as they go; which stored page of a URL counts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_crawl import SEED, page_table, url

from catalog.queries import site_pages
from pageloom.operators.bundle import run_statistics
from pageloom.operators.crawl import StagedEdges
from pageloom.plans.runs import run_bulk
from pageloom.plans.store import RunStore
from pageloom.session import run_scope, stage, stage_folder
from pageloom.sources.layout import read_clustered, write_clustered
from pageloom.sources.pages import fetch_pages

GRAPH = {"S": ["P1", "L1", "P7"], "L1": ["P2", "P3", "L2"], "L2": ["P4"], "P1": [], "P2": [], "P3": [], "P4": []}


def files(path):
    return {p for p in Path(path).rglob("*") if p.is_file()}


def tables(spark):
    return {t.name for t in spark.catalog.listTables()}


def documents(df):
    return sorted((r.file_key, r.rank, r.clean_html) for r in df.collect())


def test_half_runs_add_up_to_a_whole_one(spark, tmp_path):
    pages = page_table(spark, GRAPH)
    half = pages.filter(~F.col("url").rlike("-p[23]/"))
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.manifest().collect() == [] and store.documents() is None and store.outcomes() is None
    shared = stage_folder(spark).removeprefix("file:")
    before, known = files(shared), tables(spark)
    first, second = store.add(half, SEED), store.add(pages, SEED)
    assert files(shared) == before and tables(spark) == known
    assert (first["pages"], first["ok"], first["missing"]) == (5, 2, 3)
    assert (second["pages"], second["ok"], second["missing"]) == (3, 2, 1)
    assert documents(store.documents()) == documents(run_bulk(pages, SEED).documents)
    assert [r.run for r in store.manifest().orderBy("run").collect()] == [1, 2]
    third = store.add(pages, SEED)
    assert (third["pages"], third["ok"], third["missing"]) == (1, 0, 1)

    # A run that broke off before its commit is not read, and its number is used again.
    broken = documents(store.documents())
    store.documents().drop("run").withColumn("clean_html", F.lit("broken")).write.parquet(str(tmp_path / "store/documents/run=4"))
    assert documents(store.documents()) == broken
    store.add(pages, SEED)
    assert documents(store.documents()) == broken and store.manifest().count() == 4


def test_a_store_holds_a_document_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    store.add(page_table(spark, GRAPH), SEED)
    assert {p.name for p in (tmp_path / "store").iterdir()} == {"outcomes", "manifest"}
    whole = documents(store.documents())
    assert whole == documents(run_bulk(page_table(spark, GRAPH), SEED).documents) and len(whole) == 4
    # A run that broke off left outcomes of its own; its number is used again.
    left = store.outcomes().drop("run").withColumns({"clean_html": F.lit("broken"), "rank": F.lit(99).cast("long")})
    left.write.parquet(str(tmp_path / "store/outcomes/run=2"))
    assert documents(store.documents()) == whole
    store.add(page_table(spark, GRAPH), SEED)
    assert documents(store.documents()) == whole and store.manifest().count() == 2


def test_files_of_a_site_hold_short_and_long_pages(spark, testdata):
    for file in site_pages(spark, testdata).inputFiles():
        kinds = {r.page_id % 2: r["count"] for r in spark.read.parquet(file).groupBy((F.col("page_id") % 2).alias("page_id")).count().collect()}
        assert kinds[0] == kinds[1] > 0


def test_a_run_counts_as_it_writes(spark):
    for pages in (page_table(spark, GRAPH), page_table(spark, GRAPH).limit(0)):
        run = run_bulk(pages, SEED)
        counts = {r.status: r.n for r in run_statistics(run.outcomes).collect()}
        assert {s: n for s, n in run.counts.items() if n and s != "pages"} == counts
        assert run.counts["pages"] == sum(counts.values())


def test_a_scope_ends_with_its_tables(spark):
    outside, known = stage_folder(spark), tables(spark)
    with pytest.raises(RuntimeError), run_scope(spark) as folder:
        staged = stage(spark.range(10), "inside")
        edges = stage(spark.range(100).selectExpr("string(id % 3) AS src", "int(id) AS pos", "string(id) AS dst", "true AS is_page"), "edges")
        assert StagedEdges.of(edges, 10).table.count() == 100 and len(tables(spark) - known) == 1
        assert staged.count() == 10 and folder.startswith(outside) and stage_folder(spark) == folder
        raise RuntimeError("broken off")
    assert stage_folder(spark) == outside and not Path(folder.removeprefix("file:")).exists()
    assert tables(spark) == known


@pytest.mark.parametrize("clustered", [False, True])
def test_the_first_valid_snapshot_counts(spark, tmp_path, clustered):
    good, late = "<title>t</title><div class='entry-content'><p>good</p></div>", "<div class='entry-content'><p>late</p></div>"
    wait = "<title>Just a moment...</title><div class='entry-content'><p>wait</p></div>"
    versions = {"P1": [None, wait, good, late], "P2": [wait, None, ""], "P3": [None, ""], "P4": [None], "P5": [good, late]}
    rows = [(10 * i + k, url(name) + "?v" * k, html) for i, (name, stored) in enumerate(versions.items()) for k, html in enumerate(stored)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if clustered:
        write_clustered(pages, str(tmp_path / "p"))
        pages = read_clustered(spark, str(tmp_path / "p"))
    wanted = spark.createDataFrame([(url(n).rstrip("/"), 0, i) for i, n in enumerate([*versions, "P9"])], "norm_url string, depth int, rank long")
    got = {r.rank: r.page_id for r in fetch_pages(wanted, pages).collect()}
    assert got == {0: 2, 1: 10, 2: 20, 3: 30, 4: 40, 5: None}


def test_a_listing_is_read_past_its_challenge(spark):
    pages = page_table(spark, {"S": ["L1"], "L1": ["P2"], "P2": []})
    waits = pages.filter(F.col("url").endswith("-l1/")).select(F.lit(-1).cast("long").alias("page_id"), "url", F.lit("<title>Just a moment...</title>").alias("html"))
    assert [r.file_key for r in run_bulk(pages.unionByName(waits), SEED).documents.collect()] == ["stack-questions-answers-p2"]
