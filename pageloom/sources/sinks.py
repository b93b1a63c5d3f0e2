"""Write documents and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.bundle import bundle_members

ROWS_PER_FILE = 100_000


def _shelved(df: DataFrame, key: str, folders: int | None) -> tuple[DataFrame, str]:
    """The column that names a row's folder: the key itself, or one of ``folders`` numbers drawn from its hash."""
    if folders is None:
        return df, key
    return df.withColumn("shelf", F.pmod(F.xxhash64(key), F.lit(folders))), "shelf"


def write_documents(
    docs: DataFrame, path: str, subject: str | None = None, fmt: str = "parquet", mode: str = "overwrite", folders: int | None = None
) -> None:
    """One row per document; a folder per subject when given, or a fixed number of ``folders`` for keys that are many.

    Without a subject nothing is shuffled. With one, rows of a folder are brought together
    so that not every task writes to every folder; a large one is still split.
    """
    folder = None
    if subject:
        docs, folder = _shelved(docs, subject, folders)
        docs = docs.hint("rebalance", folder)
    writer = docs.write.mode(mode).format(fmt).option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(folder) if folder else writer).save(path)


def read_written(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """What a sink wrote. The schema keeps folder names what they were: a key 007 stays text."""
    return spark.read.schema(schema).format(fmt).load(path)


def write_bundles(
    parts: DataFrame, path: str, key: str, fmt: str = "parquet", mode: str = "overwrite", folders: int | None = None
) -> None:
    """The parts of all bundles in order; range partitions split a large bundle over tasks."""
    parts, folder = _shelved(parts, key, folders)
    ordered = parts.repartitionByRange(folder, key, "part").sortWithinPartitions(folder, key, "part")
    ordered.write.mode(mode).format(fmt).partitionBy(folder).save(path)


def write_indexed(docs: DataFrame, path: str, key: str, order: list[str], body: str) -> None:
    """S7 for bundles of any size: one document per row in bundle order, and the index of ``bundle_members``.

    Range partitions split a large bundle over tasks; the index holds no bodies.
    """
    ordered = docs.select(key, *order, body).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ordered.write.parquet(f"{path}/members")
    bundle_members(docs, key, order, body).repartitionByRange(key, "start").sortWithinPartitions(key, "start").write.parquet(f"{path}/index")


def read_indexed(spark: SparkSession, path: str, key: str, value: str, order: list[str], start: int = 0, stop: int | None = None) -> DataFrame:
    """The members of one bundle that hold bytes from ``start`` up to ``stop``: (*order, member, start, length, body).

    Key and offsets reach the scan of the index, the key that of the members.
    """
    index = spark.read.parquet(f"{path}/index").filter(F.col(key) == value).filter(F.col("start") + F.col("length") > start)
    if stop is not None:
        index = index.filter(F.col("start") < stop)
    return spark.read.parquet(f"{path}/members").filter(F.col(key) == value).join(index.drop(key), order)
