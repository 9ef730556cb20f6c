"""Layout of a fuzzy neighbour graph in few dimensions, and the uniform-manifold embedding built on it.

Positions are a table (id, features). An epoch is one pass of joins: edges pull both ends
together by their weights, and every point is pushed from a few partners chosen by hash, so
that nothing but the positions grows with the points and no task holds more than a bucket.
All points move at once, by the mean pull of their edges (an edge at a time would have to
move in a fixed order); results repeat for one seed up to rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplexa.operators.common import settle, written
from simplexa.operators.linear import pca
from simplexa.operators.neighbors import fit_curve, fuzzy_union, knn, local_scale, membership

#: Points of a bucket whose members are each other's partners, about.
BUCKET = 256
#: Largest move by one edge or partner in one dimension.
CLIP = 4.0


def random_start(points: DataFrame, dims: int = 2, seed: int = 42) -> DataFrame:
    """(id, features): uniform in [-10, 10], by a hash of id, dimension and seed."""
    draw = [F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(1 << 30)) / F.lit((1 << 30) / 20.0) - 10.0 for i in range(dims)]
    return points.select("id", F.array(*draw).alias("features"))


def pca_start(points: DataFrame, dims: int = 2, seed: int = 42) -> DataFrame:
    """(id, features): principal components scaled to a greatest coordinate of 10, with noise of 1e-4 against ties."""
    made = pca(points, dims).transform(points)
    top = made.agg(F.max(F.expr("array_max(transform(features, e -> abs(e)))")).alias("top"))
    noise = random_start(points, dims, seed).select("id", F.col("features").alias("noise"))
    both = made.crossJoin(F.broadcast(top)).join(noise, "id")  # one row
    return both.select("id", F.expr("zip_with(features, noise, (e, z) -> if(top > 0, 10 * e / top, 0D) + 1e-5 * z)").alias("features"))


def pruned(graph: DataFrame, epochs: int) -> DataFrame:
    """Edges (i, j, w) that a layout of so many epochs would use at least once: those of the greatest weight over epochs or more."""
    top = graph.agg(F.max("w").alias("top"))
    return graph.crossJoin(F.broadcast(top)).where(F.col("w") >= F.col("top") / epochs).select("i", "j", "w")  # one row


def _clipped(force: Column, dims: int) -> list[Column]:
    return [F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), force * (F.col("x")[d] - F.col("y")[d]))) for d in range(dims)]


def epoch(graph: DataFrame, at: DataFrame, a: float, b: float, step: float, dims: int, partners: int, gamma: float, salt: int, many: int) -> DataFrame:
    """(id, features) after all ``many`` points of ``at`` have moved once; ``graph`` is symmetric (i, j, w)."""
    far = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)
    x, y = at.select(F.col("id").alias("i"), F.col("features").alias("x")), at.select(F.col("id").alias("j"), F.col("features").alias("y"))
    pull = F.when(F.col("far") > 0, F.lit(-2 * a * b) * F.pow("far", F.lit(b - 1)) / (1 + F.lit(a) * F.pow("far", F.lit(b)))).otherwise(0.0)
    pulled = graph.join(x, "i").join(y, "j").withColumn("far", far)
    pulled = pulled.groupBy("i").agg(*((F.sum(F.col("w") * m) / F.sum("w")).alias(f"p{d}") for d, m in enumerate(_clipped(pull, dims))))
    # partners are the next points of a bucket in the order of this epoch's hash
    buckets = x.withColumn("o", F.xxhash64("i", F.lit(salt))).withColumn("bucket", F.pmod(F.xxhash64("i", F.lit(~salt)), F.lit(max(1, many // BUCKET))))
    order = Window.partitionBy("bucket").orderBy("o", "i").rowsBetween(1, partners)
    pushed = buckets.withColumn("near", F.collect_list("x").over(order)).select("i", "x", F.explode("near").alias("y")).withColumn("far", far)
    push = F.lit(2 * gamma * b) / ((0.001 + F.col("far")) * (1 + F.lit(a) * F.pow("far", F.lit(b))))
    pushed = pushed.groupBy("i").agg(*(F.sum(m).alias(f"q{d}") for d, m in enumerate(_clipped(push, dims))))
    moved = x.join(pulled, "i", "left").join(pushed, "i", "left")
    place = [F.col("x")[d] + F.lit(step) * (F.coalesce(f"p{d}", F.lit(0.0)) + F.coalesce(f"q{d}", F.lit(0.0)) * F.when(F.col("p0").isNotNull(), 1.0).otherwise(0.0)) for d in range(dims)]
    return moved.select(F.col("i").alias("id"), F.array(*place).alias("features"))


def layout(graph: DataFrame, start: DataFrame, epochs: int = 60, min_dist: float = 0.1, spread: float = 1.0, step: float = 0.3, partners: int = 5, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, features): ``start`` moved for so many epochs, by steps that fall to 0.

    Points without an edge stay; an empty graph leaves ``start``. Positions are written
    to the shared checkpoint folder after each epoch: a lost executor costs one.
    """
    a, b = fit_curve(spread, min_dist)
    graph, at = written(pruned(graph, epochs)), written(start)
    first, many = at.first(), at.count()
    for n in range(epochs if first is not None else 0):
        at = written(epoch(graph, at, a, b, step * (1 - n / epochs), len(first["features"]), partners, gamma, seed * 1_000_003 + n, many))
    return at


def umap(points: DataFrame, k: int = 15, dims: int = 2, metric: str = "euclidean", min_dist: float = 0.1, spread: float = 1.0, epochs: int = 60, init: str | DataFrame = "pca", seed: int = 42, mix: float = 1.0) -> DataFrame:
    """(id, features): the uniform-manifold embedding of (id, features); ``init`` is pca, random or a table (id, features).

    Points without features have no place. New points are placed by ``streaming.insertion.interpolate``.
    """
    points = settle(points.where("features is not null").select("id", "features"))
    edges = settle(knn(points, k - 1, metric))
    graph = fuzzy_union(membership(edges, local_scale(edges, k)), mix)
    if isinstance(init, DataFrame):
        start = init.select("id", "features")
    elif points.isEmpty():
        start = points.select("id", F.col("features").cast("array<double>"))
    elif init in ("pca", "random"):
        start = (pca_start if init == "pca" else random_start)(points, dims, seed)
    else:
        raise ValueError(f"unknown init {init!r}")
    return layout(graph, start, epochs, min_dist, spread, seed=seed)
