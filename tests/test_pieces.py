"""Sources, sinks, bundles and orders."""

import base64
import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.operators import bundle
from pageloom.operators.htmltree import NodeColumns, number_page
from pageloom.operators.skew import hot_keys, number_rows, salted_join
from pageloom.session import stage
from pageloom.sources import assets, sinks
from pageloom.sources.pages import resolve_attempts


def test_asset_rules(spark):
    limit = 1000
    rows = [
        ("small", "image/png", 3, 3, True),
        ("case and parameters", "IMAGE/PNG; charset=x", None, 3, True),
        ("type", "image/svg+xml", 3, 3, False),
        ("no type", None, 3, 3, False),
        ("announced too long", "image/gif", limit + 1, 3, False),
        ("really too long", "image/webp", None, limit + 1, False),
        ("exactly the limit", "image/jpeg", limit, limit, True),
    ]
    table = spark.createDataFrame(
        [(n, t, a, bytearray(b"x" * size)) for n, t, a, size, _ in rows],
        "img_url string, content_type string, content_length long, payload binary",
    )
    got = {r.img_url: r.data_uri for r in assets.accept_images(table, limit=limit).collect()}
    assert set(got) == {n for n, *_, ok in rows if ok}
    assert got["case and parameters"] == "data:image/png; charset=x;base64,eHh4"
    assert got["exactly the limit"] == "data:image/jpeg;base64," + base64.b64encode(b"x" * limit).decode()
    lenient = {r.img_url for r in assets.accept_images(table, strict=False).collect()}
    assert lenient == {n for n, t, *_ in rows if t and t.lower().startswith("image")}


def test_image_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    table = assets.read_image_files(spark, str(tmp_path), {"png": "image/png"}, "http://i/")
    assert [tuple(r) for r in assets.accept_images(table).collect()] == [("http://i/a.PNG", "data:image/png;base64,YWJj")]


def test_image_files_are_written_once_and_long_ones_not_read(spark, tmp_path):
    rows = [("a/1.png", b"abc"), ("a/2 b.png", b"d"), ("3.png", b"x" * 50), ("c/d/4.png", None), ("empty.png", b"")]
    table = spark.createDataFrame([(n, p, "x") for n, p in rows], "name string, payload binary, path string")
    path = f"file:{tmp_path}/images"
    assert [assets.write_image_files(table, path) for _ in range(2)] == [4, 4]   # a repeated attempt writes the same
    assert sorted(str(p.relative_to(tmp_path / "images")) for p in (tmp_path / "images").rglob("*.png")) == ["3.png", "a/1.png", "a/2 b.png", "empty.png"]
    read = assets.read_image_files(spark, path, {"png": "image/png"}, "http://i/", limit=49)
    assert "LessThanOrEqual(length,49)" in read._jdf.queryExecution().executedPlan().toString()
    assert {(r.img_url, bytes(r.payload)) for r in read.collect()} == {("http://i/a/1.png", b"abc"), ("http://i/a/2 b.png", b"d")}   # empty files are passed over
    assert assets.read_image_files(spark, path, {"png": "image/png"}, "http://i/").count() == 3
    assert assets.write_image_files(table.limit(0), f"{path}-none") == 0


def test_image_files_are_listed_by_tasks(spark, tmp_path):
    """No name of a file comes to the driver; hidden and unfinished files are no data, at any depth."""
    for name in ("a/b/c/1.png", "a/.x-1", "_SUCCESS", "_t/2.png", "k=1/_h=2/3.webp", "z._COPYING_", "odd %41 é.JPG", "e/none.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "none" in name else name.encode())
    read = assets.read_image_files(spark, f"{tmp_path}/", {"png": "image/png", "jpg": "image/jpeg"}, "http://i/")
    assert not [f for f in read.inputFiles() if str(tmp_path) in f]
    assert {(r.img_url, r.content_type, r.content_length, bytes(r.payload).decode()) for r in read.collect()} == {
        (f"http://i/{n}", kind, len(n.encode()), n)
        for n, kind in (("a/b/c/1.png", "image/png"), ("k=1/_h=2/3.webp", ""), ("odd %41 é.JPG", "image/jpeg"))
    }


def test_attempts(spark):
    histories = {
        "first": ["ok"], "retried": ["error", "error", "ok"], "too late": ["error", "error", "error", "ok"],
        "final": ["error", "rejected", "ok"], "given up": ["error"],
    }
    rows = [(k, i, o) for k, h in histories.items() for i, o in enumerate(h)]
    out = resolve_attempts(spark.createDataFrame(rows, "url string, t int, o string"), "url", ["t"], F.col("o"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2   # also before the shuffle: a hot key stays small
    assert {r.url: (r.attempts, r.status) for r in out.collect()} == {
        "first": (1, "ok"), "retried": (3, "ok"), "too late": (3, "failed"), "final": (2, "failed"), "given up": (1, "failed"),
    }


def test_last_writer_and_parts(spark):
    docs = spark.range(1000).select(
        F.col("id").alias("rank"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("file_key"),
        F.col("id").cast("string").alias("body"),
    )
    last = {r.file_key: r.rank for r in bundle.last_writer_wins(docs).collect()}
    assert last["hot"] == 999 and len(last) == 667
    parts = bundle.bundle_parts(docs, "file_key", "rank", "body", width=100).filter("file_key = 'hot'").orderBy("part").collect()
    assert max(r.n_docs for r in parts) <= 100
    assert "\n".join(r.body for r in parts).split("\n") == [str(i) for i in range(0, 1000, 3)]


def test_last_of_staged(spark):
    """As the window finds them; where no key has two documents the table comes back as it is, and nothing is shuffled."""
    docs = stage(spark.range(500).selectExpr("id % 3 as run", "id as rank", "CASE WHEN id % 7 < 2 THEN 'hot' ELSE concat('k', id) END as file_key", "repeat('x', int(id)) as body"), "docs")
    want = bundle.last_writer_wins(docs.withColumn("at", F.struct("run", "rank")), "file_key", "at").drop("at")
    got = bundle.last_of_staged(docs, ["run", "rank"])
    assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, want.select(docs.columns).collect()))
    alone = bundle.last_of_staged(docs.filter("file_key <> 'hot'"), ["rank"])
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == docs.filter("file_key <> 'hot'").count()


def test_members_have_offsets(spark, tmp_path):
    """A key with most documents lies in several partitions; multi-byte, empty and null bodies count in bytes."""
    docs = spark.range(3000).select(
        (F.col("id") * 7919 % 3001).alias("rank"), F.when(F.col("id") % 10 != 0, "hot").when(F.col("id") % 20 == 0, None).otherwise(F.col("id").cast("string")).alias("file_key"),
        F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'é' ELSE repeat('x', int(id % 50)) END").alias("body"),
    )
    rows = sorted((r.file_key or "", r.rank, len((r.body or "").encode())) for r in docs.collect())
    got = bundle.bundle_members(docs, "file_key", ["rank"], "body").collect()
    assert {(r.file_key or "", r.rank, r.length) for r in got} == set(rows) and len(got) == len(rows)
    at, nth = {}, {}
    want = {}
    for k, rank, length in rows:
        want[k, rank] = nth.get(k, 0) + 1, at.get(k, 0)
        nth[k], at[k] = nth.get(k, 0) + 1, at.get(k, 0) + length + 1
    assert {(r.file_key or "", r.rank): (r.member, r.start) for r in got} == want

    sinks.write_indexed(docs, str(tmp_path / "i"), "file_key", ["rank"], "body")
    hot = [(rank, *want[k, rank], length) for k, rank, length in rows if k == "hot"]
    part = sinks.read_indexed(spark, str(tmp_path / "i"), "file_key", "hot", ["rank"], 1000, 1500).collect()
    assert sorted((r.rank, r.member, r.start, r.length) for r in part) == [h for h in hot if h[2] + h[3] > 1000 and h[2] < 1500]


def test_empty_inputs_keep_their_schema(spark):
    none = spark.createDataFrame([], "rank long, file_key string, url string, status string, body string")
    assert bundle.run_statistics(none).collect() == []
    assert bundle.failed_members(none).columns == ["file_key", "url", "status"]
    assert bundle.bundle_parts(none, "file_key", "rank", "body").columns == ["file_key", "part", "n_docs", "body"]


def test_bundle_name(spark):
    when = datetime.datetime(2024, 3, 1, 4, 5, 6)
    name = spark.range(1).select(bundle.bundle_name(F.lit(when), "Merged_")).first()[0]
    assert name == "Merged_20240301_040506"


def test_sinks(spark, tmp_path):
    docs = spark.range(50).select((F.col("id") % 2).alias("subject"), F.col("id").alias("rank"), F.col("id").cast("string").alias("body"))
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        sinks.write_documents(docs, path, "subject", fmt)
        assert spark.read.format(fmt).load(path).count() == 50
    path = str(tmp_path / "text")
    sinks.write_documents(docs.select("subject", "body"), path, "subject", "text")
    assert sorted(int(r.value) for r in spark.read.text(path).collect()) == list(range(50))
    sinks.write_bundles(bundle.bundle_parts(docs, "subject", "rank", "body", width=10), str(tmp_path / "b"), "subject")
    back = spark.read.parquet(str(tmp_path / "b")).orderBy("subject", "part").collect()
    assert [(r.subject, r.part, r.n_docs) for r in back] == [(s, p, 5) for s in (0, 1) for p in range(5)]


def test_sinks_with_many_keys(spark, tmp_path):
    """A fixed number of folders, and keys that look like numbers stay text."""
    keys = ["007", "42", "a b/c", "1e5"] + [f"k{i}" for i in range(40)]
    docs = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "file_key string, part long")
    for write in (sinks.write_documents, sinks.write_bundles):
        path = str(tmp_path / write.__name__)
        write(docs, path, "file_key", folders=4)
        assert len(list((tmp_path / write.__name__).glob("shelf=*"))) == 4
        back = sinks.read_written(spark, path, "file_key string, part long").collect()
        assert {(r.file_key, r.part) for r in back} == set(map(tuple, docs.collect())) and len(back) == len(keys)


def test_number_rows(spark):
    rows = spark.range(997).select(F.pmod(F.col("id") * 7919, F.lit(997)).alias("v"), F.array(F.col("id")).alias("x"))
    got = number_rows(rows, ["v"], "n").collect()
    assert len(got) == 997 and all(r.n == r.v + 1 for r in got)
    assert number_rows(rows.filter("v < 0"), ["v"], "n").collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(spark, how):
    many = stage(spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 100).cast("string")).alias("k"), F.col("id").alias("v")), "many")
    one = spark.createDataFrame([("hot", 1), ("7", 2), ("unused", 3)], "k string, w int")
    hot = hot_keys(many, "k", hot_rows=50)
    assert 1 <= hot.count() < 200
    got = salted_join(many, one, "k", ["v"], hot, how).select("k", "v", "w")
    want = many.join(one, "k", how).select("k", "v", "w")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert hot_keys(many, "k") is None


def nodes(source):
    out = NodeColumns()
    number_page(source, out)
    return [(t or k, p) for k, t, p in zip(out.kind, out.tag, out.parent)]


def test_tree_recovery():
    shape = [t for t, _ in nodes("<p><b>x<br><p>y</p></i><td>z")]
    assert shape == ["html", "body", "p", "b", "text", "br", "p", "text", "td", "text"]
    assert [t for t, _ in nodes("plain")] == ["html", "body", "p", "text"]
    assert [t for t, _ in nodes("<title>a<b>c</title>d")][:5] == ["html", "head", "title", "text", "body"]
    lists = nodes("<ul><li>a<li>b</ul>")
    assert [p for t, p in lists if t == "li"] == [2, 2]
    cells = nodes("<table><tr><td>a<td>b<tr><td>c</table>")
    assert [p for t, p in cells if t == "tr"] == [2, 2]
    anchors = nodes("<a href=1>x<a href=2>y</a>")
    assert [p for t, p in anchors if t == "a"] == [1, 1]
    assert [t for t, _ in nodes("<a href=x/>y</a>")] == ["html", "body", "a", "text"]
    assert nodes("<b><div>x</b>y</div>")[-1] == ("text", 3)
    assert nodes("") == []


def test_depth_and_size_stay_linear():
    out = NodeColumns()
    number_page("<b>" * 20000 + "<div>" * 20000 + "</i>" * 20000 + '<p x="' * 2000, out)
    assert len(out) > 40000
