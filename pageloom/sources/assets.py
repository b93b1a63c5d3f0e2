"""Stored images that may be embedded."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.profile import IMAGE_TYPES, MAX_IMAGE_BYTES
from pageloom.session import stage

# What a batch and a task of reading image files hold, about.
FILES_PER_BATCH, BYTES_PER_BATCH = 10_000, 16 << 20
FILES_PER_TASK, BYTES_PER_TASK = 20_000, 128 << 20


def _uri(path: str) -> str:
    """``path`` as Arrow's file systems take it."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def write_image_files(images: DataFrame, path: str) -> int:
    """One file below ``path`` for each row of (name, payload), and how many; a null payload is no file.

    Tasks write what they hold; a file gets its name when it is whole, so repeated attempts do no harm. Names are
    unique and may have folders: Spark lists many folders as a job of its own.
    """

    uri = _uri(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(uri)
        made = set()
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder, _, last = f"{root}/{name}".rpartition("/")
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                unfinished = f"{folder}/.{last}-{uuid.uuid4().hex}"
                with files.open_output_stream(unfinished) as out:
                    out.write(payload.as_buffer())
                files.move(unfinished, f"{folder}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = images.filter("payload is not null").select("name", "payload")
    return rows.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the files below ``path``, found by tasks, a level of folders at a time.

    As in Spark's listing, names that begin with "." or "_" are no data, nor is what is still being copied. No name comes to
    the driver; a task lists a folder at a time.
    """
    uri = _uri(path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root))
                for at in range(0, len(found), FILES_PER_BATCH):
                    infos = [f for f in found[at : at + FILES_PER_BATCH] if not f.base_name.startswith(".") and not f.base_name.endswith("._COPYING_")
                             and (not f.base_name.startswith("_") or "=" in f.base_name)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{folder}/{f.base_name}" if folder else f.base_name for f in infos], pa.string()),
                        pa.array([None if f.type == fs.FileType.Directory else f.size for f in infos], pa.int64()),
                    ], names=["name", "length"])

    folders, levels = spark.createDataFrame([("",)], "name string"), []
    while True:
        level = stage(folders.mapInArrow(listed, "name string, length bigint"), "image-files")
        levels.append(level.filter("length IS NOT NULL"))
        inner = level.filter("length IS NULL").select("name")  # folders
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        folders = inner.repartition(_tasks(spark), "name")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_image_files(spark: SparkSession, path: str, types: dict[str, str], base_url: str, limit: int | None = None) -> DataFrame:
    """Image files as an asset table; ``types`` maps a file ending to its content type.

    The URL of an asset is ``base_url`` and the file's path below ``path``. Tasks list and read the files, so
    the driver holds none of their names. Files of over ``limit`` bytes are left out by the scan of
    the listing and not opened; empty files are passed over, too.
    """
    files = _listed_files(spark, path)
    if limit is not None:
        files = files.filter(F.col("length") <= limit)
    files = files.filter("length > 0")
    uri = _uri(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)

        def emitted(names, payloads):
            lengths = pa.array([len(p) for p in payloads], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lengths, pa.array(payloads, pa.binary())], names=["name", "length", "payload"])

        for batch in batches:
            names, payloads, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as file:
                    payloads.append(file.readall())
                names.append(name)
                held += len(payloads[-1])
                if held >= BYTES_PER_BATCH:
                    yield emitted(names, payloads)
                    names, payloads, held = [], [], 0
            if names:
                yield emitted(names, payloads)

    weight = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(_tasks(spark), -(-weight.n // FILES_PER_TASK), -(-weight.bytes // BYTES_PER_TASK))
    contents = files.select("name").repartition(tasks, "name").mapInArrow(read, "name string, length bigint, payload binary")
    ending = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    kind = F.coalesce(*[F.when(ending == e, t) for e, t in types.items()], F.lit(""))
    return contents.select(
        F.concat(F.lit(base_url), "name").alias("img_url"), kind.alias("content_type"), F.col("length").alias("content_length"), "payload"
    )


def accepted_type(content_type, types=IMAGE_TYPES):
    """An allowed type somewhere in the header."""
    test = F.lit(False)
    for allowed in types:
        test = test | F.lower(content_type).contains(allowed)
    return F.coalesce(test, F.lit(False))


def accepted_size(content_length, payload, limit: int = MAX_IMAGE_BYTES):
    """I4: neither the announced nor the real length is over the limit."""
    return (content_length.isNull() | (content_length <= limit)) & (F.octet_length(payload) <= limit)


def data_uri(content_type, payload):
    """The encoder breaks lines; a data URI must not."""
    encoded = F.translate(F.base64(payload), "\r\n", "")
    return F.concat(F.lit("data:"), F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";base64,"), encoded)


def acceptable_images(
    assets: DataFrame, types=IMAGE_TYPES, limit: int = MAX_IMAGE_BYTES, strict: bool = True
) -> DataFrame:
    """(img_url, content_type, payload) of the assets that may be embedded, not encoded yet.

    ``strict=False`` is the lenient rule I6: any data URI that starts with data:image.
    """
    kind, length, payload = F.col("content_type"), F.col("content_length"), F.col("payload")
    if strict:
        # The announced length comes first: it can be tested by the scan.
        test = accepted_type(kind, types) & accepted_size(length, payload, limit)
    else:
        test = F.lower(kind).startswith("image") & payload.isNotNull()
    return assets.filter(test).select("img_url", "content_type", "payload")


def encode_images(images: DataFrame) -> DataFrame:
    """(img_url, data_uri)."""
    return images.select("img_url", data_uri(F.col("content_type"), F.col("payload")).alias("data_uri"))


def accept_images(
    assets: DataFrame, types=IMAGE_TYPES, limit: int = MAX_IMAGE_BYTES, strict: bool = True
) -> DataFrame:
    """(img_url, data_uri) of the assets that may be embedded."""
    return encode_images(acceptable_images(assets, types, limit, strict))
