"""A blocked Bloom filter as a table: one row per block of eight 64-bit words.

A key sets one bit in each word of its block. The number of blocks is bounded whatever the number of keys, so the
table may be broadcast; too many keys fill it, so that more rows seem to be in it, and no row that is in it is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BLOCK_BITS = 64 * WORDS
BITS_PER_KEY = 16
# 2^19 blocks of eight words are 32 MB, enough for 16 million keys at full strength.
MAX_BLOCKS = 1 << 19


def blocks_for(n_keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    """A power of two, at most ``max_blocks``."""
    wanted = max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))
    return min(1 << (wanted - 1).bit_length(), max_blocks)


def bits(key: Column) -> list[Column]:
    """The bit that a key sets in each word of its block."""
    drawn = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def block_of(key: Column, n_blocks: int) -> Column:
    return F.xxhash64(key, F.lit("block")).bitwiseAND(F.lit(n_blocks - 1))


def bloom_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7), a row per block in use."""
    return keys.groupBy(block_of(F.col(key), n_blocks).alias("block")).agg(*[F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(bits(F.col(key)))])


def possible(rows: DataFrame, key: str, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """``rows`` with ``possible``: whether the filter holds the row's key, or seems to."""
    asked = rows.withColumn("block", block_of(F.col(key), n_blocks))
    met = asked.join(F.broadcast(bloom), "block", "left")  # at most MAX_BLOCKS rows
    all_set = reduce(Column.__and__, (F.col(f"w{i}").bitwiseAND(bit) != 0 for i, bit in enumerate(bits(F.col(key)))))
    return met.withColumn("possible", F.coalesce(all_set, F.lit(False))).drop("block", *(f"w{i}" for i in range(WORDS)))
