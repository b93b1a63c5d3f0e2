"""Whitening against exact sums and a plain covariance, on the smallest vectors and on awkward rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from pageloom.llm import queries, whitening

NAN, INF = float("nan"), float("inf")
BASE = [[math.sin(i * (d + 1)) for d in range(6)] for i in range(40)]
ROWS = (
    [(i, v) for i, v in enumerate(BASE)] + [(100 + i, BASE[7]) for i in range(25)] + [(None, BASE[3]), (None, [0.0] * 6), (5, BASE[5]), (5, BASE[6])]
    + [(200, None), (201, []), (202, [NAN] * 6), (203, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (204, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [0.3] * 9)]
    + [(300, [1e4, -1e4, 3.0, 0.1, 0.2, 0.3]), (301, [-500.0, 70000.5, 0.0, 1.0, 0.0, 0.1])]
)


def plain(rows, components=32, distinct=False):
    """Exact integers and a covariance by numpy over all rows, or over distinct vectors."""
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = max(Counter(len(x) for _, x in kept).items(), key=lambda p: (p[1], p[0]))[0]
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = sorted({x for _, x in kept}) if distinct else [x for _, x in kept]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in kept)
    mean = np.array([s / n for s in sums])
    covariance = (np.array(fit) - mean).T @ (np.array(fit) - mean) / n
    return n, sums, deviation, np.sort(np.linalg.eigvalsh(covariance))[::-1][:components], covariance, [(i, np.array(x) - mean) for i, x in kept]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, v, "clash", 1) for i, v in ROWS]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, count int").repartition(3)


@pytest.mark.parametrize("weights, share_rows", [("counts", 1_000_000), ("one", 1_000_000), ("counts", 4)])
def test_whiten(awkward, weights, share_rows):
    """Also with shares of four rows, so that repeated vectors are hot."""
    made = whitening.whiten(awkward, components=4, weights=weights, share_rows=share_rows)
    rows = [(r["vec_id"], r["embedding"]) for r in awkward.collect()]
    n, sums, deviation, values, covariance, vectors = plain(rows, 4, weights == "one")
    got = made.rows.collect()
    assert (made.n, made.sums) == (n, sums)
    assert Counter((r["id"], r["deviation"]) for r in got) == deviation
    assert np.allclose(made.eigenvalues, values, rtol=1e-9) and np.allclose(made.explained, values / np.trace(covariance), rtol=1e-9)
    assert made.identity_error < 1e-6
    # The whitened values of a row are its projections: V^-1 restricted to the components.
    _, directions = np.linalg.eigh(covariance)
    chosen = directions[:, ::-1][:, :4]
    want = defaultdict(list)
    for i, x in vectors:
        want[i].append(np.abs(x @ chosen / np.sqrt(values)))
    for r in got:
        assert any(np.allclose(np.abs(r["whitened"]), w, rtol=1e-6, atol=1e-6) for w in want[r["id"]])


def test_query(spark, testdata):
    got = queries.op11_whitening(spark, testdata).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{testdata}/embeddings.parquet").collect()]
    n, _, deviation, values, covariance, vectors = plain(rows)
    assert len(got) == 32 * len(rows) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 33))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    (error,) = {r["identity_error"] for r in got}
    assert error < 1e-9
    share = {r["component"]: r["explained"] for r in got}
    assert np.allclose([share[c + 1] for c in range(32)], values / np.trace(covariance), rtol=1e-9)
    made = np.zeros((n, 32))
    for r in got:
        made[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs((made - made.mean(0)).T @ (made - made.mean(0)) / n - np.eye(32)).max() < 1e-9
    # Components are eigenvectors: the covariance of x with a component is e times its direction, so of length sqrt(e).
    x = np.array([v for _, v in sorted(vectors, key=lambda p: p[0])])
    assert np.allclose(np.linalg.norm(x.T @ made / n, axis=0), np.sqrt(values), rtol=1e-9)


def test_no_variance_and_no_rows(spark, awkward):
    same = spark.createDataFrame([(i, [0.5, -0.25]) for i in range(3)], "vec_id long, embedding array<double>")
    assert {tuple(r["whitened"]) for r in whitening.whiten(same).rows.collect()} == {(None, None)}
    flat = spark.createDataFrame([(i, [0.5, float(i)]) for i in range(3)], "vec_id long, embedding array<double>")
    made = whitening.whiten(flat)
    assert made.identity_error < 1e-12 and all(r["whitened"][1] is None and r["whitened"][0] is not None for r in made.rows.collect())
    assert whitening.digest(whitening.whiten(awkward.limit(0))).count() == 0


def test_large_numbers_stay_exact():
    """Beyond a long a deviation is null; below it, it is exact however large the entries."""
    entries = np.array([[1 << 40, 3], [0, 5]])
    sums = [int(s) for s in entries.sum(0)]
    assert whitening.deviations(entries, sums, 2, 1 << 40).to_pylist() == [None, None]
    entries = np.array([[1 << 30, 3], [0, 5]])
    sums = [int(s) for s in entries.sum(0)]
    assert whitening.deviations(entries, sums, 2, 1 << 30).to_pylist() == [(1 << 60) + 4] * 2
    keys = whitening.keys_of(np.array([[1, -127], [1, 128], [1 << 40, 0]]))
    assert [k[0] for k in keys] == [1, 2, 8]
