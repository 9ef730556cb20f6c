"""The kernels that meet block against block: brute force on odd points, and figures that must not grow with the square of the points."""

import numpy as np
import pytest

from simplexa.functions import sparse
from simplexa.operators import blocks, linear, neighbors, quality


def _clouds(width):
    rng = np.random.default_rng(width)
    yield rng.normal(size=(150, width)), rng.normal(size=(2600, width))
    yield rng.integers(0, 3, (120, width)).astype(float), rng.integers(0, 3, (2200, width)).astype(float)  # ties, zeros, copies
    yield 1e6 + rng.normal(size=(100, width)) * 1e-3, 1e6 + rng.normal(size=(2100, width)) * 1e-3
    far = rng.normal(size=(2300, width))
    far[5] = 1e30
    yield far[:100], far
    yield np.ones((60, width)), np.ones((2400, width))
    yield rng.normal(size=(20, width)), rng.normal(size=(7, width))


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "chebyshev"])
@pytest.mark.parametrize("width", [1, 2, 33])
def test_top(metric, width):
    for x, y in _clouds(width):
        ids, other = np.arange(len(x)) + 3, np.random.default_rng(0).permutation(len(y))
        near, dist = neighbors._top(x, y, ids, other, 6, metric)
        measure = neighbors.measure(metric, x, y)
        for r in range(0, len(x), 7):
            d = measure(np.full(len(y), r), np.arange(len(y)))
            d[other == ids[r]] = np.inf
            best = np.lexsort((other, d))[:6]
            best = best[np.isfinite(d[best])]
            assert near[r][: len(best)].tolist() == other[best].tolist() and dist[r][: len(best)].tolist() == d[best].tolist()
            assert (near[r][len(best) :] == -1).all()


def test_blocks_are_few(spark):
    """What a pass shuffles is the points times the blocks, so these must not grow with the points."""
    points = spark.range(100_000).selectExpr("id", "array(1D, 2D) as features")
    assert [blocks.count(points.limit(n))[0] for n in (0, 100, 50_000, 100_000)] == [1, 1, 12, 12]
    assert blocks.count(points.selectExpr("id", "array_repeat(1D, 4000) as features").limit(50_000))[0] == 48


def test_bytes():
    for a in (np.array([0.1, 0.2]), np.array([[0.5], [3e300]]), np.arange(4.0).reshape(2, 2), np.array([3, -1])):
        b = blocks.from_bytes(blocks.to_bytes(a), len(a))
        assert b.dtype == a.dtype and b.shape == a.shape and (a == b).all()


@pytest.mark.parametrize("width", [1, 2, 33])
def test_below(width):
    for x, y in _clouds(width):
        other = np.random.default_rng(1).permutation(len(y))
        order = np.argsort(other)
        y, other = y[order], other[order]
        near = np.random.default_rng(2).integers(0, len(y), (len(x), 3))
        left, right = {"id": np.arange(len(x)) + 3, "features": x, "near": near}, {"id": other, "features": y}
        left["far"] = quality._given_pairs(left, right)[0]["far"]
        measure = neighbors.measure("euclidean", x, y)
        got = quality._below(left, right)[0]["below"]
        for r in range(0, len(x), 7):
            d = measure(np.full(len(y), r), np.arange(len(y)))
            for t in range(3):
                before = (d < d[near[r, t]]) | ((d == d[near[r, t]]) & (other < near[r, t]))
                assert got[r, t] == (before & (other != left["id"][r])).sum()


def test_label_sums():
    for x, y in _clouds(3):
        kind = np.random.default_rng(0).integers(-2, 40, len(y))
        left, right = {"features": x, "kind": kind, "known": kind}, {"features": y, "kind": kind}
        each, whole = quality._label_sums(left, right)
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        assert whole["sizes"].sum() == len(y)
        for n, kind_ in enumerate(whole["kinds"]):
            assert each["sums"][:, n] == pytest.approx(d[:, kind == kind_].sum(1), rel=1e-9)


def test_no_table_of_pairs(spark):
    """Neither ranks nor silhouettes nor given distances may make a row for each pair."""
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, rng.normal(size=3).tolist(), int(i % 4) or None) for i in range(500)], "id long, features array<double>, label int")
    assert neighbors.distances(points, 4).count() == 500 * 4
    x = np.array([r.features for r in points.orderBy("id").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    label, s = np.arange(500) % 4, 0.0
    for i in range(500):
        mean = {g: d[i, label == g].sum() / ((label == g).sum() - (g == label[i])) for g in (1, 2, 3)}
        if label[i]:
            own = mean.pop(label[i])
            s += (min(mean.values()) - own) / max(own, min(mean.values()))
    assert quality.silhouette(points).first()["score"] == pytest.approx(s / 500)
    assert quality.silhouette(points.limit(1)).first()["score"] is None
    assert quality.rank_trustworthiness(points, points.selectExpr("id", "slice(features, 1, 1) as features"), 5).count() == 5


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "cosine", "manhattan", "jaccard_positive"])
def test_pairwise(spark, metric, monkeypatch):
    """As by the sums over joined entries; several blocks, absent places, entries of one place, nulls and zeros."""
    monkeypatch.setattr(sparse, "ENTRIES", 40)
    rng = np.random.default_rng(9)
    rows = lambda n: [(int(i), int(k), float(v)) for i in range(n) for k, v in zip(rng.choice(30, 4, replace=False), rng.choice([-1.5, 0.25, 2.0], 4), strict=True)]
    x, y = rows(25) + [(30, 4, 0.0), (31, 900, 1.0), (32, 3, None), (5, 29, 1.0), (5, 29, 0.5)], rows(12) + [(40, 7, 0.0)]
    x, y = (spark.createDataFrame(v, "id long, idx int, val double") for v in (x, y))
    made = sparse.pairwise(x, y, metric, 1000)
    pairs = x.select("id").distinct().toDF("i").crossJoin(y.select("id").distinct().toDF("j"))
    want = {(r.i, r.j): r.d for r in sparse.distances(pairs, x, y, metric, 1000).collect()}
    assert {(r.i, r.j): r.d for r in made.collect()} == pytest.approx(want, abs=1e-12)
    assert "idx" not in made.columns and "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_local_dimension(spark):
    """By each point's own decomposition; lists of several lengths, neighbours alike, and no call of Python for each point."""
    x = np.random.default_rng(11).normal(size=(40, 6)) * [9, 5, 2, 1, 1, 0.1]
    x[30:] = x[30]
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    lists = {0: [1], 1: [2, 3], 2: [5, 6, 7, 8, 9], 3: list(range(10, 30)), 4: [30, 31, 32], 5: [7, 30]}
    edges = spark.createDataFrame([(i, j) for i, l in lists.items() for j in l], "i long, j long")
    made = linear.local_dimension(points, edges)
    for r in made.collect():
        y = x[lists[r.i]]
        values = np.linalg.svd(y - y.mean(0), compute_uv=False) ** 2
        assert r.dims == (int(np.argmax(np.cumsum(values) / values.sum() > 0.8)) + 1 if values.sum() > 0 else 1)
    assert made.count() == len(lists) and "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()
