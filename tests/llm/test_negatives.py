"""Hard negatives against brute force, on clustered vectors and on awkward rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import negatives

NAN = float("nan")


def plain(rows, low=30, high=90, positives=5, most=10):
    """Every score of every anchor, by whole numbers."""
    kept = []
    for place, (i, v, label) in enumerate(rows):
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((place, i, [max(-negatives.LARGEST, min(negatives.LARGEST, math.floor(256 * c))) for c in v], label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = Counter()
    for place, i, x, label in kept:
        if i is None or i % 10:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=False)), j, p, other) for p, j, y, other in kept if p != place]
        for score, j, _, _ in sorted((s for s in scored if s[3] == label), key=order)[:positives]:
            fits = sorted((s for s in scored if s[3] != label and low * score <= 100 * s[0] <= high * score), key=order)[:most]
            out.update((i, j, rank, k, score, s) for rank, (s, k, _, _) in enumerate(fits, 1))
    return out


def clustered(n=400, width=16, seed=3):
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((6, width))
    return [(i, [float(c) for c in np.float32(middles[i % 6] + 0.15 * draw.standard_normal(width))], int(draw.integers(0, 3))) for i in range(n)]


AWKWARD = [(i, v[:4], l) for i, v, l in clustered(120, 4)] + [
    (None, [1.0, 1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 1), (130, None, 1), (140, [], 1), (150, [NAN, 1.0, 0.0, 0.0], 1), (160, [1.0, None, 0.0, 0.0], 1),
    (170, [1.0, 1.0, 0.5, 0.5], None), (10, [1.0, 1.0, 0.5, 0.5], 0), (10, [1.0, 1.0, 0.5, 0.5], 0), (11, [1.0, 1.0, 0.5, 0.5], 1), (11, [1.0, 1.0, 0.5, 0.5], 1), (180, [2.0], 2),
    (181, [1.5], 1), (182, [0.0] * 4, 0), (-20, [0.0] * 4, 0), (190, [-1.0, 0.0, 0.0, 0.0], 7), (191, [-0.5, 0.0, 0.0, 0.0], 7), (200, [1.0, 2.0, 3.0, 4.0], 8),
    (210, [40000.0, 60000.0, 0.5, 0.25], 5), (211, [1e30, 3.0, 0.5, 0.25], 5), (212, [12345.678, 0.0, 7.0, 1.0], 6),
]


def mined(table, **more):
    return Counter(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 10 == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("more", [{}, {"tile_rows": 16, "block": 8}])
def test_awkward_rows(spark, more):
    """Also in many tiles and blocks."""
    rows = [(i, v, label, "clash", 1) for i, v, label in AWKWARD]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, tile string, score int").repartition(3)
    assert mined(table, **more) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])
    assert mined(table.limit(0), **more) == Counter()


@pytest.mark.parametrize("more", [{}, {"tile_rows": 50, "block": 8, "positives": 2, "negatives": 3, "low": 10, "high": 99}])
def test_clustered(spark, more):
    rows = clustered()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain(rows, more.get("low", 30), more.get("high", 90), more.get("positives", 5), more.get("negatives", 10))
    assert want and mined(table, **more) == want


def test_tree_and_bounds_spare_scores(monkeypatch):
    """A tree spans all anchors over their shortest edges; near anchors then score few candidates."""
    draw = np.random.default_rng(1)
    middles = draw.standard_normal((8, 32)) * 300
    anchors = np.floor(middles[0] + draw.standard_normal((40, 32)))
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and parent[0] == 0 and all(p < i for i, p in enumerate(parent) if i)
    grown = anchors[order]
    assert np.allclose(edge[1:], [np.linalg.norm(grown[i] - grown[parent[i]]) for i in range(1, 40)])
    between = np.linalg.norm(anchors[:, None] - anchors[None], axis=2)
    inside, total = {0}, 0.0
    while len(inside) < 40:
        short, now = min((between[i, j], j) for i in inside for j in range(40) if j not in inside)
        inside.add(now)
        total += short
    assert math.isclose(edge.sum(), total)

    matrix = np.floor(middles[np.arange(4000) % 8] + 2 * draw.standard_normal((4000, 32)))
    tile = negatives.Tile(np.arange(4000), np.ones(4000, bool), np.arange(4000), np.arange(4000) % 8, matrix)
    exact, asked = grown @ matrix.T, []
    scores = negatives.Tile.scores
    monkeypatch.setattr(negatives.Tile, "scores", lambda self, a, chosen: asked.append(len(self.rows[chosen])) or scores(self, a, chosen))
    searches = [negatives.Search([(1000, 10**9)], 5) for _ in range(40)]
    negatives.search_tile(tile, grown, parent, edge, lambda a, part: np.ones(len(tile.rows[part]), bool), searches)
    for a, search in enumerate(searches):
        want = sorted(range(4000), key=lambda j: (-exact[a, j], j))[:5]
        assert list(search.found[0].places) == want
    assert sum(asked) < 0.5 * exact.size
