"""The embedding keeps neighbours and clusters; starts and edge cases."""

import numpy as np
import pytest

from simplexa.operators import layout
from simplexa.operators.neighbors import knn
from simplexa.operators.quality import neighbor_overlap


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(40, 6)) * 0.3 + c for c in (0, 4, 8)])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(2)


def test_umap(spark, blobs):
    made = layout.umap(blobs, k=10, epochs=12)
    got = {r.id: np.array(r.features) for r in made.collect()}
    assert len(got) == 120 and all(np.isfinite(v).all() and len(v) == 2 for v in got.values())
    x = np.stack([got[i] for i in range(120)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = np.argsort(d, axis=1)[:, 1:6]
    assert (near // 40 == np.arange(120)[:, None] // 40).mean() > 0.98
    overlap = neighbor_overlap(knn(blobs, 10), knn(made, 10), 10).first()["overlap"]
    assert overlap > 0.35  # 0.08 by chance
    assert np.linalg.norm(np.stack([got[i] for i in range(40)]).std(0)) > 0.05


def test_starts(spark, blobs):
    top = [np.abs(r.features).max() for r in layout.pca_start(blobs).collect()]
    assert max(top) == pytest.approx(10, abs=1e-3)
    drawn = np.array([r.features for r in layout.random_start(blobs, 3).collect()])
    assert drawn.shape == (120, 3) and np.abs(drawn).max() <= 10 and drawn.std() > 3
    assert layout.umap(blobs.limit(0), epochs=2).count() == 0
    with pytest.raises(ValueError, match="init"):
        layout.umap(blobs, init="nonsense", epochs=1)


def test_points_without_edges_stay(spark):
    graph = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "i long, j long, w double")
    start = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 0.0]), (3, [1.0, 1.0])], "id long, features array<double>")
    got = {r.id: r.features for r in layout.layout(graph, start, epochs=3).collect()}
    assert got[3] == [1.0, 1.0] and 0 < got[2][0] - got[1][0] < 5
