"""Embedding whitening by weighted multiplicity covariance.

Entries become whole numbers. Rows with one vector form a group, which is kept once with its count. Sums are
exact; the covariance adds weighted, centred products group by group; each distinct vector is whitened once.
A vector that one row has goes out with that row; only the rows of repeated vectors are joined back.

What meets on the driver has the size of the dimension: its sums, and its square for the covariance.

Defined results: rows whose vector is null, empty or holds null or non-finite entries take no part, nor do
vectors of another length than most have (of two lengths equally frequent, the longer counts). A null id stays
null; rows that repeat are rows each. Entries are held within 2^52 after scaling. A component without variance
has whitened values of null and takes no part in the identity's error. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.vectors import floored, whole_vectors
from pageloom.operators.skew import HOT_ROWS, salted_join
from pageloom.session import stage

OFFSET = 1_000_000
LARGEST = 1 << 52
# A key names the width of its entries first: the smallest that holds them all, so that equal vectors have equal keys.
WIDTHS = {1: (1 << 7) - 1, 2: (1 << 15) - 1, 4: (1 << 31) - 1, 8: (1 << 63) - 1}


@dataclass(frozen=True)
class Whitening:
    rows: DataFrame          # id, deviation, whitened: one row per vector that takes part
    n: int                   # the length of the fit list
    sums: list[int]          # per dimension, over the fit list
    eigenvalues: np.ndarray  # of the components, falling
    explained: np.ndarray    # their shares of the trace
    identity_error: float    # largest absolute entry of the whitened covariance minus the identity


def keys_of(matrix: np.ndarray) -> list[bytes]:
    """A vector's key, from its entries less the offset."""
    largest = np.abs(matrix).max(1)
    keys = np.empty(len(matrix), object)
    below = np.zeros(len(matrix), bool)
    for width, most in WIDTHS.items():
        now = ~below & (largest <= most)
        for place, row in zip(np.flatnonzero(now), matrix[now].astype(f"<i{width}"), strict=True):
            keys[place] = bytes([width]) + row.tobytes()
        below |= now
    return list(keys)


def entries_of(keys: pa.Array, dimension: int) -> np.ndarray:
    """The entries less the offset, a row per key."""
    rows = np.empty((len(keys), dimension), np.int64)
    for place, key in enumerate(keys.to_pylist()):
        rows[place] = np.frombuffer(key, f"<i{key[0]}", dimension, 1)
    return rows


def keyed(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dimension, key) of the rows whose vector is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, matrix in whole_vectors(batch.column("vector")):
                keys = keys_of(floored(matrix, scale, LARGEST))
                dimension = np.full(len(places), matrix.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(places)), pa.array(dimension), pa.array(keys, pa.binary())], ["id", "dimension", "key"])

    id_type = vectors.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return named.mapInArrow(run, f"id {id_type}, dimension int, key binary")


def exact_sums(groups: DataFrame, dimension: int) -> tuple[list[int], int]:
    """Weighted sums per dimension of the entries less the offset, and the largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, weights = entries_of(batch.column("key"), dimension), batch.column("weight").to_numpy()
            largest = np.abs(entries).max(0, initial=0)
            if int(largest.max()) * int(weights.sum()) >= 1 << 62:
                entries, weights = entries.astype(object), weights.astype(object)
            totals = [Decimal(int(t)) for t in weights @ entries]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array(totals, pa.decimal128(38, 0)), pa.array(largest)], ["place", "total", "largest"])

    partial = groups.select("key", "weight").mapInArrow(run, "place int, total decimal(38,0), largest long")
    rows = partial.groupBy("place").agg(F.sum("total").alias("total"), F.max("largest").alias("largest")).collect()
    totals = {r["place"]: int(r["total"]) for r in rows}
    return [totals[i] for i in range(dimension)], max(r["largest"] for r in rows)


def products(rows: DataFrame, matrix_of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """Sum over ``rows`` of weight * (v, 1) (v, 1)': weighted products, and in the last column weighted sums.

    A task adds up its own rows; the tasks' matrices are added in Spark, entry by entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            matrix, weights = matrix_of(batch), batch.column("weight").to_numpy().astype(np.float64)
            weighted = (matrix * weights[:, None]).T
            total[:, :width] += weighted @ matrix
            total[:, width] += weighted.sum(1)
        i, j = np.divmod(np.arange(total.size), width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "total"])

    added = rows.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toPandas()
    out = np.zeros((width, width + 1))
    out[added["i"], added["j"]] = added["total"]
    return out


def centred(entries: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S / n, rounded once: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums])
    rest = np.array([(s % n) / n for s in sums])
    return (entries - whole) - rest


def deviations(entries: np.ndarray, sums: list[int], n: int, largest: int) -> pa.Array:
    """Exact sum over dimensions of (n x - S)^2; null where it does not fit a long."""
    whole = np.array([s // n for s in sums])
    rest = [s % n for s in sums]
    if (2 * n * (2 * largest + 1)) ** 2 * len(sums) < 1 << 63:
        return pa.array(((n * (entries - whole) - np.array(rest)) ** 2).sum(1))
    exact = ((n * (entries - whole).astype(object) - np.array(rest, object)) ** 2).sum(1)
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, components: int = 32, weights: str = "counts", share_rows: int = HOT_ROWS,
) -> Whitening:
    """Whitened vectors of floor(scale * entry) + 1,000,000; ``weights``: "counts" fits on all rows, "one" on distinct vectors."""
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    spark = vectors.sparkSession
    rows = keyed(vectors, id_col, vector_col, scale)
    id_type = rows.schema["id"].dataType.simpleString()
    # The row of a group of one is known by min(); of larger groups it is not used.
    groups = stage(rows.groupBy("dimension", "key").agg(F.count("*").alias("count"), F.min("id").alias("id")), "vector-groups")
    frequent = groups.groupBy("dimension").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), F.desc("dimension")).first()
    if frequent is None:
        none = spark.createDataFrame([], f"id {id_type}, deviation long, whitened array<double>")
        return Whitening(none, 0, [], np.zeros(0), np.zeros(0), 0.0)
    dimension = frequent["dimension"]
    weight = F.col("count") if weights == "counts" else F.lit(1).cast("long")
    groups = groups.filter(F.col("dimension") == dimension).withColumn("weight", weight)
    n = groups.agg(F.sum("weight")).first()[0]
    sums, largest = exact_sums(groups, dimension)

    covariance = products(groups.select("key", "weight"), lambda batch: centred(entries_of(batch.column("key"), dimension), sums, n), dimension)[:, :dimension] / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    # Of either sign, the one whose largest entry is positive.
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(len(values))])
    varied = values > max(values[0], 0) * dimension * np.finfo(float).eps
    stretched = directions / np.sqrt(np.where(varied, values, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = entries_of(batch.column("key"), dimension)
            whitened = centred(entries, sums, n) @ stretched
            lists = pa.ListArray.from_arrays(np.arange(0, whitened.size + 1, len(values), dtype=np.int32), pa.array(whitened.ravel(), mask=np.tile(~varied, len(whitened))))
            columns = [batch.column(c) for c in ("key", "count", "weight", "id")]
            yield pa.RecordBatch.from_arrays([*columns, deviations(entries, sums, n, largest), lists], ["key", "count", "weight", "id", "deviation", "whitened"])

    schema = f"key binary, count long, weight long, id {id_type}, deviation long, whitened array<double>"
    distinct = stage(groups.select("key", "count", "weight", "id").mapInArrow(run, schema), "whitened")

    def whitened_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("whitened").flatten().fill_null(0).to_numpy().reshape(len(batch), len(values))

    narrow = distinct.select("weight", "whitened")
    middle = products(narrow, whitened_of, len(values))[:, -1] / n
    spread = products(narrow, lambda batch: whitened_of(batch) - middle, len(values))[:, :-1] / n
    off = np.abs(spread - np.eye(len(values)))[np.ix_(varied, varied)]

    alone = distinct.filter("count = 1").select("id", "deviation", "whitened")
    shared = distinct.filter("count > 1")
    # Groups of more rows than a task takes are cut into shares. Their number is small: each has very many rows.
    hot = shared.filter(F.col("count") > share_rows).select(F.xxhash64("key").alias("_key_hash"), F.ceil(F.col("count") / share_rows).cast("int").alias("_salts"))
    hot = stage(hot.groupBy("_key_hash").agg(F.max("_salts").alias("_salts")), "hot-vectors")
    spare = rows.filter(F.col("dimension") == dimension).select("id", "key").withColumn("_place", F.monotonically_increasing_id())
    joined = salted_join(spare, shared.select("key", "deviation", "whitened"), "key", ["_place"], None if hot.isEmpty() else hot)
    out = alone.unionByName(joined.select("id", "deviation", "whitened"))
    return Whitening(out, n, [s + OFFSET * n for s in sums], values, values / np.trace(covariance) if varied.any() else np.zeros(len(values)), float(off.max(initial=0)))


def digest(made: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    explained = F.array(*[F.lit(float(e)) for e in made.explained]) if len(made.explained) else F.array().cast("array<double>")
    return made.rows.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        F.col("id").alias(id_col), (F.col("place") + 1).cast("int").alias("component"), F.lit(made.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(made.identity_error).cast("double").alias("identity_error"))
