"""Session settings and intermediate tables that outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

STAGED_TABLE = "pageloom_staged"
# What a job over large page tables wants; none of it changes results.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every column costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(name: str = "pageloom") -> SparkSession.Builder:
    build = SparkSession.builder.appName(name)
    for key, value in RECOMMENDED.items():
        build = build.config(key, value)
    return build


# The folder of the run that is going on, if it has one of its own.
_run_folder: ContextVar[str | None] = ContextVar("run folder", default=None)


def _ending(folder: str) -> str:
    """What the names of a folder's staged tables end in: they go with a run's folder."""
    return "_in_" + re.sub(r"\W", "_", folder.rstrip("/").rpartition("/")[2])


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Whatever is staged inside lies in a folder of its own below the shared one and goes when the scope ends.

    Results that are to stay are written elsewhere before that; lazy ones end with the scope.
    """
    folder = f"{stage_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(token)
        for table in spark.catalog.listTables():
            if table.name.startswith(STAGED_TABLE) and table.name.endswith(_ending(folder)):
                spark.sql(f"DROP TABLE `{table.name}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_folder(spark: SparkSession) -> str:
    """The folder of the run, else the shared one named by spark.checkpoint.dir; a temporary one in local mode only."""
    if (own := _run_folder.get()) is not None:
        return own
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pageloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and lets the optimizer see the real size,
    so that it broadcasts a staged table only when that is under the configured limit.
    """
    return written(df, f"{stage_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as read back from ``path``, over which it is written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What jobs inside shuffle is deleted when they end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage_bucketed(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """``stage`` in buckets by ``by``, as many as Spark shuffles into: joins on exactly these columns
    read them where they are, however often.

    The files lie in the same shared folder; the table's name is known to this session only.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = stage_folder(spark)
    name = f"{label}-{uuid.uuid4().hex}"
    table = re.sub(r"\W", "_", f"{STAGED_TABLE}_{name}") + _ending(folder)
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{folder}/{name}").saveAsTable(table, format="parquet")
    return spark.table(table)
