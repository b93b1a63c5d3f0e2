"""Keyed documents, ordered bundles and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.skew import number_rows
from pageloom.profile import BUNDLE_PREFIX, BUNDLE_TIME_FORMAT
from pageloom.session import stage

# A page that came through a challenge is cleaned like the others.
WITH_DOCUMENT = ("ok", "challenge")


def last_writer_wins(docs: DataFrame, key: str = "file_key", order: str = "rank") -> DataFrame:
    """Of the documents with one key, the last in order.

    Each map task forwards only its own last document per key.
    """
    window = Window.partitionBy(key).orderBy(F.desc(order))
    return docs.withColumn("_turn", F.row_number().over(window)).filter("_turn = 1").drop("_turn")


def last_of_staged(docs: DataFrame, order: list[str], key: str = "file_key") -> DataFrame:
    """S6 of a table that can be read twice, has no null ``key`` and an ``order`` unique within it.

    Which documents have a later one is found by keys alone; these are left out, so where they are few no document moves.
    """
    narrow = docs.select(key, *order)
    last = narrow.groupBy(key).agg(F.max(F.struct(*order)).alias("_last"), F.count("*").alias("_n"))
    several = last.filter("_n > 1").select(key, "_last")
    earlier = stage(narrow.join(several, key).filter(F.struct(*order) < F.col("_last")).select(key, *order), "earlier")
    return docs if earlier.isEmpty() else docs.join(earlier, [key, *order], "left_anti")


def bundle_parts(
    docs: DataFrame, key: str, order: str, body: str, width: int = 100, separator: str = "\n", first: int = 0
) -> DataFrame:
    """A2: (key, part, n_docs, body), each part the documents of ``width`` consecutive orders from ``first`` on.

    The parts of a key, in order, are its bundle. ``order`` is a whole number and unique
    within a key, so no group exceeds ``width`` documents however large the bundle is. A part
    is one string: for documents of any size use ``bundle_members``.
    """
    members = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(body).alias("body"))))
    part = F.floor((F.col(order) - first) / width).cast("bigint").alias("part")
    return (
        # Documents move as rows: gathered into lists before they move, they would be sorted and copied once more.
        docs.select(key, part, order, body).repartition(key, "part").groupBy(key, "part")
        .agg(members.alias("members"))
        .select(
            key, "part",
            F.size("members").cast("bigint").alias("n_docs"),
            F.array_join(F.transform("members", lambda m: m["body"]), separator).alias("body"),
        )
    )


def bundle_members(docs: DataFrame, key: str, order: list[str], body: str, separator: int = 1) -> DataFrame:
    """A2 for bundles of any size: (key, member, start, length, *order), where each document lies in its bundle.

    ``member`` counts from 1; ``start`` is the offset of the document's first byte when the
    documents of a key follow each other in ``order`` (unique within the key), ``separator``
    bytes apart. No row holds two documents and no document moves: lengths alone are range
    partitioned, added up within (partition, key), and then over the partitions of a key, so
    a key with most of all documents is spread like any other.
    """
    narrow = docs.select(key, *order, F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("length"))
    ordered = stage(narrow.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "bundle-order")
    step = F.col("length") + separator
    within = Window.partitionBy("_part", key).orderBy(*order)
    placed = ordered.select(
        "*", F.row_number().over(within).alias("_nth"), (F.sum(step).over(within) - step).alias("_from")
    )
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = ordered.groupBy("_part", key).agg(F.count("*").alias("_n"), F.sum(step).alias("_bytes"))
    starts = shares.select(
        F.col("_part").alias("_in"), F.col(key).alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_members"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_offset"),
    )
    same = (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_of"))
    return placed.join(starts, same).select(
        key, (F.col("_members") + F.col("_nth")).alias("member"), (F.col("_offset") + F.col("_from")).alias("start"), "length", *order
    )


def merged(docs: DataFrame, order: list[str], body: str, subject: str, width: int = 100) -> DataFrame:
    """A2 over stored documents: (subject, part, n_docs, body) of all of them, by ``order``.

    ``order`` must be unique, such as the key of ``last_writer_wins``.
    """
    ranked = number_rows(docs.select(*order, F.col(body).alias("_body")), order, "_rank")
    return bundle_parts(ranked.withColumn("subject", F.lit(subject)), "subject", "_rank", "_body", width, first=1)


def bundle_name(run_ts: Column, prefix: str = BUNDLE_PREFIX) -> Column:
    """A4: the run's time comes in as an argument."""
    return F.concat(F.lit(prefix), F.date_format(run_ts, BUNDLE_TIME_FORMAT))


def run_statistics(outcomes: DataFrame) -> DataFrame:
    """A1: rows per status."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def failed_members(outcomes: DataFrame) -> DataFrame:
    """A3: the pages that no document came of, as rows."""
    return outcomes.filter(~F.col("status").isin(*WITH_DOCUMENT)).select("file_key", "url", "status")
