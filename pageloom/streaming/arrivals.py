"""A7 as a stream: pages are cleaned as they arrive, each URL until it has a valid document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions import urls
from pageloom.functions.bind import bind
from pageloom.operators.bundle import WITH_DOCUMENT, last_writer_wins
from pageloom.operators.clean import clean_pages
from pageloom.operators.parse import parse_pages
from pageloom.profile import CleanRules

OUTCOMES = ("norm_url string, page_id bigint, url string, file_key string, title string, status string, "
            "clean_html string, clean_text string, batch bigint")


@dataclass(frozen=True)
class PageStream:
    """``path`` holds outcomes/batch=n and the stream's checkpoint.

    What a batch makes depends on its pages and the batches before it alone, and a batch that broke off is
    written over when Spark repeats it, so every page counts once. Batches count from when the checkpoint has them.
    """

    spark: SparkSession
    path: str
    rules: CleanRules = CleanRules()

    def start(self, arriving: DataFrame, **trigger) -> StreamingQuery:
        """Clean the pages of the stream ``arriving`` (page_id, url, html); without a trigger all that is there, then stop."""
        writer = arriving.select("page_id", "url", "html").writeStream.foreachBatch(self._add)
        return writer.option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def _add(self, arrived: DataFrame, batch: int) -> None:
        """Clean what arrived, but for URLs that an earlier batch has a valid document of.

        Addresses meet first; html moves only where the done ones among them are too many to be sent along.
        """
        arrived = bind(arrived, norm_url=urls.normalize(F.col("url")))
        if batch > 0:
            done = self._stored(batch - 1).filter("status = 'ok'").select("norm_url")
            known = done.join(arrived.select("norm_url"), "norm_url", "left_semi").distinct()
            arrived = arrived.join(known, "norm_url", "left_anti")
        cleaned = clean_pages(parse_pages(arrived, keep=("norm_url", "page_id", "url")), self.rules)
        names = [part.split()[0] for part in OUTCOMES.split(", ")][:-1]
        cleaned.select(names).write.mode("overwrite").parquet(f"{self.path}/outcomes/batch={batch}")

    def _stored(self, last: int) -> DataFrame:
        stored = arrived_so_far(self.spark, f"{self.path}/outcomes")
        return stored.filter(F.col("batch") <= last)

    def outcomes(self) -> DataFrame:
        """One row per page that was cleaned, with its ``batch``."""
        return self._stored(last_commit(self.spark, f"{self.path}/checkpoint"))

    def documents(self) -> DataFrame:
        """The document of each URL: a valid one before a challenge's, of equals the one that arrived first, of one batch
        the smallest ``page_id``. Only addresses and numbers are sorted."""
        whole = self.outcomes().filter(F.col("status").isin(*WITH_DOCUMENT))
        best = F.min(F.struct((F.col("status") != "ok").alias("worth"), "batch", "page_id")).alias("best")
        chosen = whole.groupBy("norm_url").agg(best).select("norm_url", "best.batch", "best.page_id")
        return whole.join(chosen, ["norm_url", "batch", "page_id"], "left_semi")

    def latest(self) -> DataFrame:
        """Of the documents with one ``file_key`` the last in (batch, page_id)."""
        return last_writer_wins(self.documents().withColumn("_at", F.struct("batch", "page_id")), order="_at").drop("_at")


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in system.listStatus(path)] if system.exists(path) else []


def last_commit(spark: SparkSession, checkpoint: str) -> int:
    """The number of the last batch that the checkpoint has as done, -1 before the first."""
    return max((int(name) for name in _names(spark, f"{checkpoint}/commits") if name.isdigit()), default=-1)


def arrived_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """All that is in the folders of batches; nothing before the first one."""
    if not _names(spark, folder):
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(OUTCOMES).parquet(folder)
