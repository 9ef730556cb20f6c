"""What the twins don't cover: components against numpy, insertion, sources, short neighbour lists, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexa.functions import scalars, sparse
from simplexa.operators import graph, linear, neighbors, quality
from simplexa.sources import tables
from simplexa.streaming.insertion import StreamingEmbedding, interpolate


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(4).normal(size=(80, 5)) * [5, 3, 1, 1, 0.5] + 7
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)


def test_pca(spark, cloud, tmp_path):
    x, df = cloud
    model = linear.pca(df, 2)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert model.explained_variance == pytest.approx(s[:2] ** 2 / 79)
    assert model.explained_variance_ratio == pytest.approx(s[:2] ** 2 / (s**2).sum())
    assert np.abs(np.sum(model.components * vt[:2], axis=1)) == pytest.approx([1, 1])
    assert (model.components[np.arange(2), np.abs(model.components).argmax(1)] > 0).all()
    got = np.array([r.features for r in model.transform(df).orderBy("id").collect()])
    assert got == pytest.approx((x - x.mean(0)) @ model.components.T)
    back = np.array([r.features for r in linear.pca(df, 5).inverse_transform(linear.pca(df, 5).transform(df)).orderBy("id").collect()])
    assert back == pytest.approx(x)
    tables.save_model(spark, model, str(tmp_path / "m"))
    assert tables.load_model(spark, str(tmp_path / "m")).components == pytest.approx(model.components)
    with pytest.raises(ValueError, match="no points"):
        linear.pca(df.limit(0))


def test_insertion(spark, cloud, tmp_path):
    x, df = cloud
    model = StreamingEmbedding(spark, str(tmp_path / "model"), k=3)
    assert model.fit(df.where("id < 60"), lambda p: p.select("id", F.slice("features", 1, 2).alias("features"))).count() == 60
    new = df.where("id between 60 and 69")
    once = {r.id: r.embedding for r in model.transform(new).collect()}
    for i in range(60, 70):
        d = np.sqrt(((x[:60] - x[i]) ** 2).sum(1))
        near = np.argsort(d)[:3]
        w = 1 / (d[near] + 1e-10)
        assert once[i] == pytest.approx((x[near, :2] * w[:, None]).sum(0) / w.sum())
    assert model.partial_fit(new, 1).count() == 70 and model.partial_fit(new, 1).count() == 70
    df.where("id >= 70").write.parquet(str(tmp_path / "in"))
    query = model.attach(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    held = {r.id for r in model.embedding().collect()}
    assert held >= {*range(60), *range(70, 80)}
    with pytest.raises(ValueError, match="weights"):
        interpolate(model.embedding(), new, weights="nonsense")


def test_sources(spark, cloud, tmp_path):
    x, df = cloud
    flat = df.select("id", *(F.col("features")[i].alias(f"f{i}") for i in range(5)))
    for kind in ("csv", "json", "parquet"):
        tables.write_table(flat, str(tmp_path / kind), kind)
        got = tables.read_points(spark, str(tmp_path / kind), kind, "id", [f"f{i}" for i in range(5)])
        assert np.array([r.features for r in got.orderBy("id").collect()]) == pytest.approx(x)
    tables.write_table(df, str(tmp_path / "arrays"), "csv")
    with pytest.raises(ValueError, match="kind"):
        tables.write_table(df, str(tmp_path / "x"), "xml")


def test_short_lists_and_nulls(spark):
    rows = [(i, [float(i), 0.0]) for i in range(8)]
    df = spark.createDataFrame([*rows, (99, None)], "id long, features array<double>")
    edges = neighbors.knn(df, 14)
    assert edges.groupBy("i").count().where("count = 7").count() == 8
    scale = neighbors.local_scale(edges, 15).collect()
    assert sorted(r.i for r in scale) == list(range(8)) and all(r.rho == 1 for r in scale)
    assert neighbors.fuzzy_union(neighbors.membership(edges, neighbors.local_scale(edges, 15))).count() > 0
    wide = {r.i: r.rho for r in neighbors.local_scale(edges, 15, connectivity=1.5).collect()}
    assert wide[0] == 1.5 and wide[3] == 1.0
    assert neighbors.local_scale(edges.limit(0), 15).count() == 0


def test_graph_edges(spark):
    points = spark.createDataFrame([(i,) for i in range(9)], "id long")
    edges = spark.createDataFrame([(8, 7), (7, 6), (6, 5), (1, 0), (3, 3)], "i long, j long")
    got = {r.id: r.component for r in graph.components(points, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5}
    empty = spark.createDataFrame([], "i long, j long, w double")
    assert graph.general_union(empty, empty).count() == 0 and graph.reset_local_connectivity(empty).count() == 0
    assert graph.far_distance(1.0) == 1e12 and graph.far_distance(0.5) == 5.0


def test_components_of_a_chain(spark):
    """A chain of ids in no order takes few rounds; tables of earlier rounds go."""
    order = np.random.default_rng(3).permutation(300).tolist()
    points = spark.createDataFrame([(i,) for i in range(300)], "id long")
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "i long, j long")
    rounds, was = [], graph.written
    graph.written = lambda df: rounds.append(was(df)) or rounds[-1]
    try:
        got = graph.components(points, edges)
    finally:
        graph.written = was
    assert {r.component for r in got.collect()} == {0} and len(rounds) <= 24
    gone = [x for x in rounds if not spark._jvm.java.io.File(x.scratch_path.removeprefix("file:")).exists()]
    assert len(gone) == len(rounds) - 1


def test_sparse_edges(spark):
    x = spark.createDataFrame([(1, 0, 2.0), (1, 3, 1.0), (2, 3, 1.0)], "id long, idx int, val double")
    pairs = spark.createDataFrame([(1, 2), (1, 9), (8, 9)], "i long, j long")
    got = {(r.i, r.j): r.d for r in sparse.distances(pairs, x, x, "cosine", 4).collect()}
    assert got == pytest.approx({(1, 2): 1 - 1 / math.sqrt(5), (1, 9): 1.0, (8, 9): 0.0})
    with pytest.raises(ValueError, match="unknown"):
        sparse.distances(pairs, x, x, "nonsense", 4)


def test_scalar_edges(spark):
    df = spark.createDataFrame([("abc", "abd", 0, 3)], "a string, b string, x int, y int")
    r = df.select(scalars.string("a", "b"), scalars.count("x", "y", 2.0), scalars.categorical("a", "b")).first()
    want = sum(k * math.log(2) - 2 - math.lgamma(k + 1) for k in range(3))
    assert tuple(r) == (1.0, pytest.approx(want), 1.0)


def test_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 1, 9, 3, 3]], "a double")
    got = sorted((r.a, r.a_rank) for r in quality.average_rank(df, "a", 4).collect())
    assert got == [(1.0, 1.5), (1.0, 1.5), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0), (9.0, 6.0)]


def test_curve():
    assert neighbors.fit_curve() == pytest.approx((1.576943, 0.895061), abs=1e-5)
