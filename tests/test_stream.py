"""Pages that arrive in batches: each URL until it has a valid document, whatever breaks off in between."""

from pathlib import Path

import pytest

from pageloom.streaming.arrivals import PageStream, last_commit

PAGE = "<html><head><title>{}</title></head><body><div class='entry-content'><p>{}</p></div></body></html>"


def page(number, name, words, title="a page"):
    return number, f"https://example.com/{name}/", PAGE.format(title, words)


@pytest.fixture
def arrive(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = PageStream(spark, str(tmp_path / "out"))
        arriving = spark.readStream.schema("page_id long, url string, html string").parquet(str(tmp_path / "in"))
        stream.start(arriving).awaitTermination()
        return stream

    return put


def rows_of(df):
    return sorted((r.norm_url.rsplit("/", 1)[1], r.page_id, r.status, r.batch) for r in df.collect())


def test_a_url_is_cleaned_until_it_has_a_valid_document(arrive):
    stream = arrive(page(7, "a", "not yet", "Just a moment..."), page(2, "b", "two"), page(1, "b", "one"), (3, "https://example.com/c", None))
    assert rows_of(stream.documents()) == [("a", 7, "challenge", 0), ("b", 1, "ok", 0)]
    stream = arrive(page(4, "a", "there"), page(0, "b", "too late"), page(5, "c", "at last"), page(6, "d", "new"))
    assert rows_of(stream.documents()) == [("a", 4, "ok", 1), ("b", 1, "ok", 0), ("c", 5, "ok", 1), ("d", 6, "ok", 1)]
    # What has a document already is not cleaned again; the others have a row each time.
    assert [r for r in rows_of(stream.outcomes()) if r[0] in "bc"] == [("b", 1, "ok", 0), ("b", 2, "ok", 0), ("c", 3, "missing", 0), ("c", 5, "ok", 1)]
    assert {r.clean_text for r in stream.documents().collect()} == {"there", "one", "at last", "new"}
    assert stream.latest().count() == len({r.file_key for r in stream.documents().collect()})


def test_what_broke_off_is_written_over(spark, arrive, tmp_path):
    stream = arrive(page(1, "a", "one"))
    left = arrive(page(2, "b", "two")).outcomes().filter("batch = 1").drop("batch")
    assert last_commit(spark, str(tmp_path / "out/checkpoint")) == 1
    # A batch that wrote but was not committed: its rows do not count, and the batch of that number replaces them.
    left.selectExpr("'https://example.com/ghost' AS norm_url", "* EXCEPT (norm_url)").write.parquet(str(tmp_path / "out/outcomes/batch=2"))
    assert rows_of(stream.documents()) == [("a", 1, "ok", 0), ("b", 2, "ok", 1)]
    stream = arrive(page(3, "c", "three"))
    assert rows_of(stream.documents()) == [("a", 1, "ok", 0), ("b", 2, "ok", 1), ("c", 3, "ok", 2)]


def test_nothing_yet_and_nothing_new(spark, arrive, tmp_path):
    empty = PageStream(spark, str(tmp_path / "none"))
    assert empty.outcomes().collect() == [] and empty.documents().collect() == []
    stream = arrive(page(1, "a", "one"))
    assert rows_of(stream.documents()) == [("a", 1, "ok", 0)]
    again = spark.readStream.schema("page_id long, url string, html string").parquet(str(tmp_path / "in"))
    stream.start(again).awaitTermination()
    assert rows_of(stream.outcomes()) == [("a", 1, "ok", 0)] and not Path(tmp_path / "out/outcomes/batch=1").exists()
