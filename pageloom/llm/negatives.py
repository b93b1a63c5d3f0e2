"""Hard negatives by anchor spanning trees.

Anchors are cut into blocks of near ones, each with a minimum spanning tree over their distances. Vectors lie in
tiles; every tile meets every block of anchors. In a tile the root of a block is scored in full. An anchor's score
lies within its parent's, plus or minus edge length times the candidate's norm, so a candidate is rescored only
where those bounds overlap what the anchor still looks for: first scores that reach its best positives, then the
windows that its positives open for negatives, each closed from below by the best found so far. An anchor that
did not need a candidate's exact score passes on the bounds.

A tile keeps at most the asked number of rows per anchor and positive, so what is brought together afterwards
is bounded for each anchor by the number of tiles. No threshold drops a row that belongs to the result.

Defined results: rows with a null label, or a vector that is null, empty or holds null or non-finite entries take
no part. A shorter vector counts as filled up with zeros. A row without id can be a positive or a negative (after
equal scores with an id), never an anchor. Rows that repeat are rows each; only the very row is not "other".
Entries are held within 2^24 after scaling. An anchor without positives, or whose windows hold nothing, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.vectors import floored, whole_vectors
from pageloom.session import stage

LARGEST = 1 << 24
# Anchors of a block, about; their distances are one matrix of doubles in one task.
BLOCK = 1024
# Numbers of a tile (128 MB of doubles), and the rows that a step takes at once.
TILE_NUMBERS = 1 << 24
STEP = 2048
# Anchors are sent to every tile. One in a hundred rows being an anchor, a hundred tiles send as much as the rows themselves.
TILES, TILE_ROWS = 100, 1024
# Signs of this many fixed directions: anchors that agree in them are likely near.
SIGNS = 16


def prepared(vectors: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, is_anchor, signs, vector) of the rows that take part; the vector as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, matrix in whole_vectors(batch.column("vector")):
                whole = floored(matrix, scale, LARGEST)
                drawn = np.random.default_rng(0).standard_normal((SIGNS, whole.shape[1])).T
                signs = ((whole @ drawn > 0) << np.arange(SIGNS)).sum(1)
                taken = [batch.column(c).take(pa.array(places)) for c in ("id", "label", "is_anchor")]
                packed = pa.array([row.tobytes() for row in whole.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([*taken, pa.array(signs), packed], ["id", "label", "is_anchor", "signs", "vector"])

    named = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).filter("label IS NOT NULL")
    return named.mapInArrow(run, "id long, label long, is_anchor boolean, signs long, vector binary")


def matrix_of(vectors: pa.Array, dimension: int) -> np.ndarray:
    out = np.zeros((len(vectors), dimension))
    for place, packed in enumerate(vectors.to_pylist()):
        entries = np.frombuffer(packed, "<i4")
        out[place, : len(entries)] = entries
    return out


def spanning_tree(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): a minimum spanning tree, parents first; the root is its own parent.

    ``parent`` are places within ``order``.
    """
    n, squares = len(matrix), (matrix**2).sum(1)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    # The root is the anchor nearest to their mean.
    nearest, by = np.full(n, np.inf), np.zeros(n, np.int64)
    inside, now = np.zeros(n, bool), int(((matrix - matrix.mean(0)) ** 2).sum(1).argmin())
    for turn in range(n):
        order[turn], inside[now] = now, True
        parent[turn], edge[turn] = (by[now], np.sqrt(max(nearest[now], 0))) if turn else (0, 0)
        distance = squares + squares[now] - 2 * (matrix @ matrix[now])
        closer = ~inside & (distance < nearest)
        nearest[closer], by[closer] = distance[closer], turn
        now = int(np.where(inside, np.inf, nearest).argmin())
    return order, parent, edge


def planted(anchors: DataFrame, dimension: int) -> DataFrame:
    """Anchors with their place in their block's tree: (block, place, parent, edge)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        order, parent, edge = spanning_tree(matrix_of(table["vector"].combine_chunks(), dimension))
        grown = table.take(pa.array(order))
        for name, values in (("place", np.arange(len(order), dtype=np.int32)), ("parent", parent.astype(np.int32)), ("edge", edge)):
            grown = grown.append_column(name, pa.array(values))
        return grown.select(["block", "place", "parent", "edge", "row", "id", "label", "vector"])

    schema = "block int, place int, parent int, edge double, row long, id long, label long, vector binary"
    return anchors.groupBy("block").applyInArrow(run, schema)


@dataclass
class Tile:
    """The vectors of a tile, by label, ready to be scored."""

    ids: np.ndarray      # with the largest number where there is none, see ``named``
    named: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    norms: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.matrix**2).sum(1))

    def scores(self, anchor: np.ndarray, chosen: np.ndarray | slice) -> np.ndarray:
        """Inner products as whole numbers: by doubles where these hold them, else by integers."""
        part = self.matrix[chosen]
        if np.abs(anchor).sum() * np.abs(part).max(initial=0) < 1 << 53:
            return (part @ anchor).astype(np.int64)
        return part.astype(np.int64) @ anchor.astype(np.int64)


@dataclass
class Best:
    """The best rows found for one search: highest score, then smallest id, then first row."""

    most: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, tile: Tile, scores: np.ndarray, places: np.ndarray) -> None:
        scores, places = np.concatenate([self.scores, scores]), np.concatenate([self.places, places])
        order = np.lexsort((tile.rows[places], tile.ids[places], ~tile.named[places], -scores))[: self.most]
        self.scores, self.places = scores[order], places[order]

    @property
    def floor(self) -> int | None:
        """The score that a further row must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.most else None


class Search:
    """What an anchor looks for in a tile: ranges of scores, closed from below as rows are found."""

    def __init__(self, ranges: list[tuple[int, int]], most: int):
        self.ranges, self.found = ranges, [Best(most) for _ in ranges]

    def open(self) -> list[tuple[int, int, Best]]:
        return [(max(low, best.floor) if best.floor is not None else low, high, best) for (low, high), best in zip(self.ranges, self.found, strict=True)]


def search_tile(tile: Tile, vectors: np.ndarray, parents: np.ndarray, edges: np.ndarray, allowed, searches: list[Search]) -> None:
    """Score a tile for one block of anchors, parents first.

    ``allowed(a, part)`` tells which rows of a part of the tile anchor ``a`` may take.
    """
    own = np.sqrt((vectors**2).sum(1))
    for start in range(0, len(tile.rows), STEP):
        part = slice(start, min(start + STEP, len(tile.rows)))
        norms = tile.norms[part]
        low, high = np.empty((len(vectors), len(norms))), np.empty((len(vectors), len(norms)))
        for a, (vector, parent, edge) in enumerate(zip(vectors, parents, edges, strict=True)):
            if a:
                # A trifle is added for the rounding of norms and edges.
                reach = edge * norms * (1 + 1e-9) + 1
                limit = own[a] * norms * (1 + 1e-9) + 1
                np.maximum(low[parent] - reach, -limit, out=low[a])
                np.minimum(high[parent] + reach, limit, out=high[a])
                wanted = np.zeros(len(norms), bool)
                for least, most, _ in searches[a].open():
                    if least <= most:
                        wanted |= (low[a] <= most) & (high[a] >= least)
                if not wanted.any():
                    continue
                wanted &= allowed(a, part)
                chosen = start + np.flatnonzero(wanted)
            else:
                chosen = np.arange(part.start, part.stop)
            if not len(chosen):
                continue
            scores = tile.scores(vector, part if len(chosen) == len(norms) else chosen)
            low[a, chosen - start] = high[a, chosen - start] = scores
            if not a:
                taken = allowed(a, part)
                chosen, scores = chosen[taken], scores[taken]
            for least, most, best in searches[a].open():
                hit = (scores >= least) & (scores <= most)
                if hit.any():
                    best.add(tile, scores[hit], chosen[hit])


def searched(rows: DataFrame, anchors: DataFrame, tiles: int, dimension: int, most: int, positive: bool) -> DataFrame:
    """(anchor, turn, score, id, row): in each tile the best ``most`` of each anchor's searches.

    Rows of a tile come first in its partition, then the anchors block by block, so a task holds one tile and
    one block at a time.
    """
    ranges = [F.lit(None).cast("array<long>").alias(c) for c in ("low", "high")] if positive else ["low", "high"]
    nothing = {"block": "int", "place": "int", "parent": "int", "edge": "double", "low": "array<long>", "high": "array<long>"}
    columns = ["tile", "block", "place", "parent", "edge", "row", "id", "label", "vector", "low", "high"]
    candidates = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"), *(F.lit(-1 if c in ("block", "place") else None).cast(t).alias(c) for c, t in nothing.items()))
    sent = anchors.select("*", *(ranges if positive else [])).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = candidates.select(columns).unionByName(sent.select(columns)).repartition("tile").sortWithinPartitions("tile", "block", "place", "row")
    everything = (-(1 << 62), 1 << 62)

    def allowed_in(tile: Tile, labels: np.ndarray, own: np.ndarray):
        if positive:
            return lambda a, part: (tile.labels[part] == labels[a]) & (tile.rows[part] != own[a])
        return lambda a, part: tile.labels[part] != labels[a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for pieces in runs_of(batches):
            ids, labels, own = (np.concatenate([p.column(c).fill_null(np.iinfo(np.int64).max).to_numpy() for p in pieces]) for c in ("id", "label", "row"))
            matrix = np.concatenate([matrix_of(p.column("vector"), dimension) for p in pieces])
            if pieces[0].column("block")[0].as_py() < 0:
                named = np.concatenate([p.column("id").is_valid().to_numpy(zero_copy_only=False) for p in pieces])
                order, number = np.argsort(labels, kind="stable"), pieces[0].column("tile")[0].as_py()
                tile = number, Tile(ids[order], named[order], own[order], labels[order], matrix[order])
                continue
            if tile is None or tile[0] != pieces[0].column("tile")[0].as_py():
                continue  # a tile without rows
            if positive:
                searches = [Search([everything], most) for _ in own]
            else:
                lows, highs = ([x for p in pieces for x in p.column(c).to_pylist()] for c in ("low", "high"))
                searches = [Search(list(zip(low or [], high or [], strict=True)), most) for low, high in zip(lows, highs, strict=True)]
            parents, edges = (np.concatenate([p.column(c).to_numpy() for p in pieces]) for c in ("parent", "edge"))
            search_tile(tile[1], matrix, parents, edges, allowed_in(tile[1], labels, own), searches)
            made = [(own[a], turn, best) for a, search in enumerate(searches) for turn, best in enumerate(search.found) if len(best.scores)]
            if made:
                counts, places = [len(b.scores) for _, _, b in made], np.concatenate([b.places for _, _, b in made])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([a for a, _, _ in made], counts)), pa.array(np.repeat([t for _, t, _ in made], counts).astype(np.int32)),
                    pa.array(np.concatenate([b.scores for _, _, b in made])), pa.array(tile[1].ids[places], mask=~tile[1].named[places]), pa.array(tile[1].rows[places]),
                ], ["anchor", "turn", "score", "id", "row"])

    return met.mapInArrow(run, "anchor long, turn int, score long, id long, row long")


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one tile, or of one block of anchors in a tile, as they follow each other."""
    pieces, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tiles, blocks = batch.column("tile").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tiles[start], blocks[start]
            if pieces and now != key:
                yield pieces
                pieces = []
            pieces.append(batch.slice(start, stop - start))
            key = now
    if pieces:
        yield pieces


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each search over all tiles, with their rank."""
    order = Window.partitionBy("anchor", "turn").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(
    vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, tile_rows: int = TILE_ROWS, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of the scaled, floored vectors. An anchor's positives are its first ``positives``
    other rows of its label; for each, the first ``negatives`` rows of other labels with scores from ``low`` to
    ``high`` hundredths of the positive's.
    """
    rows = stage(prepared(vectors, anchor, label, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dimension, n_anchors = rows.agg(F.count("*"), F.max(F.octet_length("vector")), F.count_if("is_anchor")).first()
    dimension = (dimension or 4) // 4
    tiles = max(1, -(-n * dimension // TILE_NUMBERS), min(TILES, -(-n // tile_rows)))
    cut = rows.filter("is_anchor").repartitionByRange(max(1, -(-n_anchors // block)), "signs", "row").withColumn("block", F.spark_partition_id())
    anchors = stage(planted(stage(cut.select("block", "row", "id", "label", "vector"), "anchor-blocks"), dimension), "anchor-trees")
    rows = rows.select("row", "id", "label", "vector")

    best = first_of(searched(rows, anchors, tiles, dimension, positives, positive=True), positives)
    best = stage(best.select(F.col("anchor").alias("row"), (F.col("rank") - 1).alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most ``positives`` per anchor; a window without whole numbers in it stays, to keep the turns.
    listed = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("turn", "positive_score"))).alias("opened"))
    score = "p.positive_score"
    hundredths = "(({s} DIV 100) * {k} + {f}(({s} % 100) * {k} / 100D))"  # no overflow on the way
    bounds = {
        "low": f"transform(opened, p -> {hundredths.format(s=score, k=low, f='ceil')})",
        "high": f"transform(opened, p -> {hundredths.format(s=score, k=high, f='floor')})",
    }
    windows = listed.select("row", *(F.expr(e).alias(c) for c, e in bounds.items()))
    mined = first_of(searched(rows, anchors.join(windows, "row", "left"), tiles, dimension, negatives, positive=False), negatives)
    named = anchors.select("row", F.col("id").alias("anchor_id")).join(best, "row")
    mined = mined.select(F.col("anchor").alias("row"), "turn", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mined.join(named, ["row", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
