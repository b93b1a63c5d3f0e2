"""Joins on hot keys and total orders, without one task that sees everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import stage

# One task can take this many rows of a key; a key with more is hot and is cut into shares of
# that size. The table of hot keys (a hash and a count each) is staged, so that its size is
# known: it is broadcast below the configured limit and shuffled beyond it.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(_key_hash, _salts) of the hot keys of a staged table; null when it is small."""
    total = df.count()
    if total <= hot_rows:
        return None
    counts = df.groupBy(F.xxhash64(key).alias("_key_hash")).count().filter(F.col("count") > hot_rows)
    return stage(
        counts.select("_key_hash", F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts")), "hot-keys"
    )


def salt_many(many: DataFrame, key: str, spread: list[str], hot: DataFrame) -> DataFrame:
    """Add ``_salt``: rows of a hot key are spread by the hash of ``spread``, others have 0."""
    return (
        many.select("*", F.xxhash64(key).alias("_key_hash")).join(hot, "_key_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_key_hash", "_salts")
    )


def salt_one(one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The single row that rows of a hot key meet, once per share."""
    return (
        one.select("*", F.xxhash64(key).alias("_key_hash")).join(hot, "_key_hash", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_key_hash", "_salts")
    )


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: list[str], hot: DataFrame | None, how: str = "inner"):
    """Join ``many`` rows per key to at most one row of ``one``.

    Rows of a hot key are spread over shares, to each of which its single row is copied.
    All other keys are joined as usual.
    """
    if hot is None:
        return many.join(one, key, how)
    return salt_many(many, key, spread, hot).join(salt_one(one, key, hot), [key, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add 1, 2, 3, ... in the given order, which must be unique.

    Range partitions are numbered side by side; each then starts after the rows of those
    before it. Only the row count per partition meets in one task.
    """
    low = (1 << 33) - 1
    numbered = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_id", 33))
    sizes = numbered.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        numbered.join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit(low)) + 1)
        .drop("_part", "_start", "_id")
    )
