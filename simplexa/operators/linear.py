"""Principal components by one pass of moments; only dimensions squared reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PCA:
    """Components (rows, each with its largest entry positive), their variances (over n - 1) and the centre."""

    components: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    mean: np.ndarray

    def transform(self, points: DataFrame) -> DataFrame:
        """(id, features): projections of (id, features), an Arrow batch at a time."""
        components, mean = self.components, self.mean

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"id": b["id"], "features": list((np.stack(b["features"]).astype(float) - mean) @ components.T)})

        return points.select("id", "features").mapInPandas(run, "id long, features array<double>")

    def inverse_transform(self, points: DataFrame) -> DataFrame:
        """(id, features): points of the source space from projections (id, features)."""
        components, mean = self.components, self.mean

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"id": b["id"], "features": list(np.stack(b["features"]).astype(float) @ components + mean)})

        return points.select("id", "features").mapInPandas(run, "id long, features array<double>")


def covariance(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance over n - 1) of (id, features); partial moments are merged centred, so that no digits cancel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if len(b):
                x = np.stack(b["features"]).astype(float)
                held = _merge(held, (len(x), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0))))
        if held is not None:
            yield pd.DataFrame({"n": [held[0]], "mean": [held[1].tobytes()], "square": [held[2].tobytes()]})

    held = None
    for r in points.select("features").where(F.col("features").isNotNull()).mapInPandas(run, "n long, mean binary, square binary").toLocalIterator():
        mean = np.frombuffer(r["mean"])
        held = _merge(held, (r["n"], mean, np.frombuffer(r["square"]).reshape(len(mean), -1)))
    if held is None:
        raise ValueError("no points")
    return held[0], held[1], held[2] / max(1, held[0] - 1)


def _merge(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + np.outer(gap, gap) * a[0] * b[0] / n


def pca(points: DataFrame, k: int = 2) -> PCA:
    """The first k principal components of (id, features)."""
    _, mean, cov = covariance(points)
    if not 1 <= k <= len(mean):
        raise ValueError(f"k must be between 1 and {len(mean)}")
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    parts = vectors[:, order].T
    parts = parts * np.sign(parts[np.arange(k), np.abs(parts).argmax(1)])[:, None]
    return PCA(parts, values[order], values[order] / values.sum() if values.sum() > 0 else np.zeros(k), mean)


def local_dimension(points: DataFrame, edges: DataFrame, share: float = 0.8) -> DataFrame:
    """(i, dims): how many components of a point's neighbours reach more than ``share`` of their variance."""
    near = edges.select("i", "j").join(points.select(F.col("id").alias("j"), "features"), "j")
    lists = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "features"))).alias("l"))
    return lists.selectExpr("i", "size(l) as size", "transform(l, e -> e.features) as x").mapInArrow(_dimensions(share), "i long, dims long")


def _dimensions(share: float):
    """A batch of points at a time; those of as many neighbours are decomposed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            if not len(size):
                continue
            x = b.column("x").flatten().flatten().to_numpy(zero_copy_only=False).reshape(size.sum(), -1)
            start, dims = np.cumsum(size) - size, np.empty(len(size), np.int64)
            for n in np.unique(size):
                alike = np.flatnonzero(size == n)
                for at in range(0, len(alike), 256):
                    part = alike[at : at + 256]
                    y = x[start[part][:, None] + np.arange(n)].astype(float)
                    values = np.linalg.svd(y - y.mean(1, keepdims=True), compute_uv=False) ** 2
                    total = values.sum(1, keepdims=True)
                    over = np.where(total > 0, np.cumsum(values, axis=1) / np.where(total > 0, total, 1), 1.0) > share
                    dims[part] = np.where(over.any(1), over.argmax(1) + 1, values.shape[1])
            yield pa.RecordBatch.from_pydict({"i": b.column("i"), "dims": dims})

    return run
