"""Near duplicates by Jaccard similarity of word n-grams, with Bayesian pruning (operator 2).

Texts with one set of shingles (all copies) are one class member. A member's signature has BANDS x ROWS MinHash
values; members that agree on a whole band meet in a bucket. There pairs are compared a part of the signature at a
time and dropped as soon as the posterior probability of reaching the threshold (uniform prior) is below
TOLERANCE. What survives links members to groups; within a group, each member brings its shingles once, and
the surviving pairs are verified exactly.

No pair is ever a row. Buckets and groups beyond a block's size are split into blocks, and each pair of blocks is
a task of its own; a block gives one row per member: how many links it has there, and one linked member, from
which the connected classes follow. So large groups of near copies lose no link.

Words are runs between white space; a shingle is five of them, or all of a shorter text. Texts without words
equal each other and link to nothing else. Every row gets its answer, also repeated ones; n_links counts all
other rows at or above the threshold. A null id never names a class with other ids. No documents: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import map_batches
from pageloom.operators.skew import HOT_ROWS, hot_keys, salted_join
from pageloom.session import stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
TOLERANCE = 1e-4
STEP = 20
# Members that a task compares with each other: by signature, by shingles, and shingles of them in all.
BUCKET_BLOCK = 512
GROUP_BLOCK = 256
GROUP_SHINGLES = 2_000_000
HIGHEST = (1 << 63) - 1
SIGNED = "at_id bigint, tie bigint, shape binary, n int, signature binary"
EDGES = "a binary, b binary"


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh3_64_intdigest
    ids = np.array([hashed(w) for w in words], np.uint64)
    n = min(n, len(ids))
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += ids[i : len(ids) - n + 1 + i]
    return np.unique(out)


def signer(values: int, seed: int = 5):
    """MinHash values of a set: for each of ``values`` hash functions the smallest hash."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 32, values, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    offsets = rng.integers(0, 1 << 32, values, dtype=np.uint64).astype(np.uint32)

    def sign(hashes: np.ndarray) -> np.ndarray:
        best = np.full(values, 0xFFFFFFFF, np.uint32)
        mixed = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
        for at in range(0, len(mixed), 4096):
            x = mixed[at : at + 4096, None] * factors + offsets
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            np.minimum(best, x.min(0), out=best)
        return best

    return sign


def least_matches(threshold: float, tolerance: float, values: int, step: int) -> list[tuple[int, int]]:
    """(values seen, fewest matches to go on): posterior P(similarity >= threshold) = P(Bin(seen + 1, threshold) <= matches)."""
    out = []
    for seen in range(step, values + 1, step):
        total, matches = 0.0, 0
        while matches <= seen:
            total += math.comb(seen + 1, matches) * threshold**matches * (1 - threshold) ** (seen + 1 - matches)
            if total >= tolerance:
                break
            matches += 1
        out.append((seen, matches))
    return out


def survivors(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, rule: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay likely, seen a part of the signature at a time."""
    matches, before = np.zeros(len(i), np.int32), 0
    for seen, least in rule:
        matches += (signatures[i, before:seen] == signatures[j, before:seen]).sum(1, dtype=np.int32)
        stay = matches >= least
        i, j, matches, before = i[stay], j[stay], matches[stay], seen
        if not len(i):
            break
    return i, j


def block_pairs(blocks: np.ndarray, crossed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs to compare among members: all, or only those of different blocks; some rows at a time."""
    n = len(blocks)
    rows = max(1, 200_000 // n)
    for at in range(0, n, rows):
        i, j = np.divmod(np.arange(at * n, min(at + rows, n) * n), n)
        fit = (j > i) & ((blocks[i] != blocks[j]) | (not crossed))
        yield i[fit], j[fit]


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member reachable from each member over the given links and those already in ``labels``."""
    while True:
        low = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, labels[i], low)
        np.minimum.at(new, labels[j], low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows equal in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) of every node of an undirected graph: large-star and small-star steps until nothing changes.

    A node of more than ``hot_rows`` edges, as the centre of a star, is met by them in shares.
    """
    pairs = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        many = 2 * seen[0] > hot_rows
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = salted_join(both, low, "a", ["b"], hot_keys(both, "a", hot_rows) if many else None)
        large = large.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        large = stage(large, "edges") if many else large
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = salted_join(large, low, "a", ["b"], hot_keys(large, "a", hot_rows) if many else None)
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).filter("a != b").distinct()
        pairs = stage(small, "edges")
        if (now := mark(pairs)) == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select("b", "b").distinct().toDF("node", "root"))
        seen = now


def cells(df: DataFrame, keys: list[str], n_blocks: str, member: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of: (block, cell, crosses)."""
    rows = df.withColumn("block", F.pmod(F.xxhash64(F.lit(17), member), F.col(n_blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col(n_blocks) - 1)).alias("other")
    rows = rows.select("*", other)
    cell = F.least("block", "other") * F.col(n_blocks) + F.greatest("block", "other")
    rows = rows.withColumn("cell", cell.cast("long"))
    # Whether the cell has two blocks: its rows do not tell, as one of the blocks may be empty.
    crosses = F.floor(F.col("cell") / F.col(n_blocks)) != F.col("cell") % F.col(n_blocks)
    return rows.withColumn("crosses", crosses).drop("other", n_blocks)


def classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, class_id, n_links, copy_of, in_class_first, text_hash) of every document.

    ``class_id`` is the smallest id among the documents linked to each other in chains, ``copy_of`` the smallest of those
    with the same shingles, ``first`` whether a row is the one to keep of its class.
    """
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(HIGHEST)).alias("at_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("at_id", F.xxhash64("text").alias("tie"), "text")
    values = BANDS * ROWS
    rule = least_matches(threshold, TOLERANCE, values, STEP)

    def sign(batch: pa.RecordBatch) -> dict:
        signed, shapes, sizes, signatures = signer(values), [], [], []
        for text in batch.column(2).to_pylist():
            found = shingles(text, shingle)
            shapes.append(blake2b(found.tobytes(), digest_size=16).digest())
            sizes.append(len(found))
            signatures.append(signed(found).tobytes())
        return {"at_id": batch.column(0), "tie": batch.column(1), "shape": pa.array(shapes, pa.binary()),
                "n": pa.array(sizes, pa.int32()), "signature": pa.array(signatures, pa.binary())}

    signed = stage(map_batches(keyed, sign, SIGNED), "signed")
    members = stage(signed.groupBy("shape").agg(
        F.min(F.struct("at_id", "tie")).alias("rep"), F.count("*").alias("size"), F.min("n").alias("n"), F.min("signature").alias("signature")), "members")

    # Buckets with company; their members come with signatures, then edges of what stays likely.
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    buckets = members.filter("n > 0").select("shape", F.explode(keys).alias("bucket"))
    company = buckets.groupBy("bucket").agg(F.count("*").alias("count")).filter("count > 1")
    company = company.select("bucket", F.ceil(F.col("count") / BUCKET_BLOCK).cast("int").alias("n_blocks"))
    met = buckets.join(company, "bucket").join(members.select("shape", "signature"), "shape")
    met = cells(met, ["bucket"], "n_blocks", "shape").select("bucket", "cell", "block", "crosses", "shape", "signature")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            n = table.num_rows
            if n > 1:
                shapes = table.column("shape").to_pylist()
                seen = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(n, -1)
                blocks = table.column("block").to_numpy()
                labels = np.arange(n)
                for i, j in block_pairs(blocks, table.column("crosses")[0].as_py()):
                    labels = joined(labels, *survivors(seen, i, j, rule))
                linked = np.flatnonzero(labels != np.arange(n)).tolist()
                if linked:
                    yield pa.RecordBatch.from_arrays([pa.array([shapes[k] for k in linked], pa.binary()), pa.array([shapes[labels[k]] for k in linked], pa.binary())], ["a", "b"])

    sorted_buckets = met.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    groups = components(sorted_buckets.mapInArrow(likely, EDGES))

    # Members of groups bring their shingles; pairs of each block are pruned again and verified exactly.
    group = groups.withColumnRenamed("node", "shape").join(members, "shape")
    sizes = group.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("n_blocks"))
    group = group.join(sizes, "root").select("root", "n_blocks", "shape", "size", "signature", F.col("rep.at_id").alias("at_id"), F.col("rep.tie").alias("tie"))

    def with_shingles(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
        return {name: batch.column(name) for name in ("group_key", "n_blocks", "shape", "size", "signature")} | {"shingles": pa.array(sets, pa.large_binary()).cast(pa.binary())}

    brought = map_batches(
        group.join(keyed, ["at_id", "tie"]).select(F.xxhash64("root").alias("group_key"), "n_blocks", "shape", "size", "signature", "text"),
        with_shingles, "group_key bigint, n_blocks int, shape binary, size bigint, signature binary, shingles binary")
    blocked = cells(brought, ["group_key"], "n_blocks", "shape").select("group_key", "cell", "block", "crosses", "shape", "size", "signature", "shingles")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            shapes = table.column("shape").to_pylist()
            places = sorted({s: k for k, s in enumerate(shapes)}.values())  # rows that repeat id and text bring a set twice
            table = table.take(pa.array(places))
            n, shapes = len(places), [shapes[k] for k in places]
            seen = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(n, -1)
            blocks, size = table.column("block").to_numpy(), table.column("size").to_numpy()
            raw = table.column("shingles").to_pylist()
            lengths = np.array([len(r) // 8 for r in raw])
            _, flat = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
            starts = np.cumsum(lengths) - lengths
            links, labels, mine = np.zeros(n, np.int64), np.arange(n), np.zeros(int(flat.max()) + 1, np.int64)
            for i, j in block_pairs(blocks, table.column("crosses")[0].as_py()):
                i, j = survivors(seen, i, j, rule)
                kept_i, kept_j = [], []
                for a in np.unique(i).tolist():
                    own = flat[starts[a] : starts[a] + lengths[a]]
                    mine[own] = 1
                    others = j[i == a]
                    if len(others) * 4 > n:
                        common = np.add.reduceat(mine[flat], starts)[others]
                    else:
                        common = np.array([mine[flat[starts[b] : starts[b] + lengths[b]]].sum() for b in others.tolist()])
                    mine[own] = 0
                    fit = others[common >= threshold * (lengths[a] + lengths[others] - common) - 1e-9]
                    kept_i.append(np.full(len(fit), a))
                    kept_j.append(fit)
                if kept_i:
                    i, j = np.concatenate(kept_i), np.concatenate(kept_j)
                    np.add.at(links, i, size[j])
                    np.add.at(links, j, size[i])
                    labels = joined(labels, i, j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shapes, pa.binary()), pa.array(links), pa.array([shapes[k] for k in labels.tolist()], pa.binary())], ["a", "links", "b"])

    sorted_blocks = blocked.repartition("group_key", "cell").sortWithinPartitions("group_key", "cell")
    found = stage(sorted_blocks.mapInArrow(verified, "a binary, links bigint, b binary"), "links")
    roots = components(found.select("a", "b"))

    links = found.groupBy(F.col("a").alias("shape")).agg(F.sum("links").alias("links"))
    rooted = members.select("shape", "rep", "size").join(links, "shape", "left").join(roots.withColumnRenamed("node", "shape"), "shape", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "shape"))
    firsts = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    rooted = rooted.join(firsts, "root").select("shape", "rep", "first", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = signed.select("at_id", "tie", "shape").join(rooted, "shape")

    def named(c):
        return F.when(c != HIGHEST, c)

    return out.select(
        named(F.col("at_id")).alias("doc_id"), named(F.col("first.at_id")).alias("class_id"), "n_links", named(F.col("rep.at_id")).alias("copy_of"),
        ((F.col("at_id") == F.col("first.at_id")) & (F.col("tie") == F.col("first.tie"))).alias("is_first"), F.col("tie").alias("text_hash"))
