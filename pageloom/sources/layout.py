"""A page table laid out for lookups by URL, whatever order its ids have.

Pages are range partitioned and sorted by normalized URL, which is stored beside them: a site lies
in few neighbouring row groups, whose smallest and largest URL are in the file's footer. A Bloom
filter per row group answers for single URLs. Both are asked by the Parquet scan itself, from the
tests that ``operators.links.url_ranges`` makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.operators.links import with_norm_url

# Bytes of a row group: what one hit costs at most.
GROUP_BYTES = 16 << 20
GROUP_URLS = 100_000


def write_clustered(pages: DataFrame, path: str, files: int | None = None, group_bytes: int = GROUP_BYTES, group_urls: int = GROUP_URLS, mode: str = "errorifexists") -> None:
    """Write (norm_url, page_id, url, html) clustered by URL; the table is shuffled once, for all runs that follow.

    A URL with very many snapshots is spread like any other, as the id is part of the order.
    ``group_urls`` sizes the Bloom filters: the distinct URLs that a row group may hold.
    """
    stored = with_norm_url(pages.select("page_id", "url", "html")).select("norm_url", "page_id", "url", "html")
    order = ["norm_url", "page_id"]
    ranged = stored.repartitionByRange(files, *order) if files else stored.repartitionByRange(*order)
    (ranged.sortWithinPartitions(*order).write.mode(mode)
     .option("parquet.bloom.filter.enabled#norm_url", "true")
     .option("parquet.bloom.filter.expected.ndv#norm_url", str(group_urls))
     .option("parquet.block.size", str(group_bytes))
     .parquet(path))


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """(norm_url, page_id, url, html), for every operator that takes stored pages."""
    return spark.read.parquet(path).select("norm_url", "page_id", "url", "html")
