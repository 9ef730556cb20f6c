"""Sparse vectors as long tables (id, idx, val): index sets, sums, products and distances by equi-joins on idx.

An absent entry is 0. Every distance is a formula of a few sums over the entries that either
vector of a pair has, so all of them cost the same two aggregations; ``n`` is the number of
features. Two vectors without entries have distance 0; null values count as absent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexa.operators import blocks

#: Entries of a block of vectors, and pairs that leave it at a time.
ENTRIES, ROWS = 1 << 19, 1 << 15

#: Sums over the entries (u, v) of a pair.
SUMS = {
    "l1": "sum(abs(u - v))",
    "l2": "sum((u - v) * (u - v))",
    "top": "max(abs(u - v))",
    "plus": "sum(abs(u + v))",
    "ratio": "sum(abs(u - v) / (abs(u) + abs(v)))",
    "uv": "sum(u * v)",
    "uu": "sum(u * u)",
    "vv": "sum(v * v)",
    "su": "sum(u)",
    "sv": "sum(v)",
    "root": "sum(sqrt(greatest(u * v, 0D)))",
    "tt": "sum(double(u != 0 and v != 0))",
    "ne": "sum(double((u != 0) != (v != 0)))",
    "differ": "sum(double(u != v))",
    "pp": "sum(double(u > 0 and v > 0))",
    "po": "sum(double(u > 0 or v > 0))",
}
FORMULAS = {
    "euclidean": "sqrt(l2)",
    "manhattan": "l1",
    "chebyshev": "top",
    "hamming": "differ / n",
    "matching": "ne / n",
    "jaccard": "coalesce(ne / nullif(tt + ne, 0D), 0D)",
    "dice": "coalesce(ne / nullif(2 * tt + ne, 0D), 0D)",
    "kulsinski": "case when ne = 0 then 0D else (ne - tt + n) / (ne + n) end",
    "rogerstanimoto": "2 * ne / (n + ne)",
    "russellrao": "case when ne = 0 then 0D else (n - tt) / n end",
    "sokalmichener": "2 * ne / (n + ne)",
    "sokalsneath": "case when ne = 0 then 0D else ne / (0.5D * tt + ne) end",
    "canberra": "ratio",
    "braycurtis": "coalesce(l1 / nullif(plus, 0D), 0D)",
    "cosine": "case when uu = 0 and vv = 0 then 0D when uu = 0 or vv = 0 then 1D else 1 - uv / sqrt(uu * vv) end",
    "correlation": "case when uu - su * su / n = 0 and vv - sv * sv / n = 0 then 0D when uv - su * sv / n = 0 then 1D else 1 - (uv - su * sv / n) / sqrt((uu - su * su / n) * (vv - sv * sv / n)) end",
    "hellinger": "case when su = 0 and sv = 0 then 0D when su = 0 or sv = 0 then 1D else sqrt(greatest(1 - root / sqrt(su * sv), 0D)) end",
    "jaccard_positive": "coalesce(1 - pp / nullif(po, 0D), 0D)",
    "sqeuclidean": "l2",
}


def from_dense(points: DataFrame, keep: str = "val != 0") -> DataFrame:
    """(id, idx, val) of the coordinates of (id, features) for which ``keep`` holds."""
    return points.select("id", F.posexplode("features").alias("idx", "val")).where(keep)


def _entries(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, idx, u, v): entries that either side of a pair (i, j) has."""
    left = pairs.join(x.select(F.col("id").alias("i"), "idx", F.col("val").alias("u")), "i").select("i", "j", "idx", "u", F.lit(0.0).alias("v"))
    right = pairs.join(y.select(F.col("id").alias("j"), "idx", F.col("val").alias("v")), "j").select("i", "j", "idx", F.lit(0.0).alias("u"), "v")
    return left.unionByName(right).groupBy("i", "j", "idx").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))


def distances(pairs: DataFrame, x: DataFrame, y: DataFrame, metric: str, n: int, p: float | None = None) -> DataFrame:
    """(i, j, d) of the pairs (i, j) of vectors of ``x`` and ``y``; ``minkowski`` takes ``p``."""
    sums, formula = dict(SUMS), FORMULAS.get(metric)
    if metric == "minkowski":
        sums["power"], formula = f"sum(pow(abs(u - v), {float(p or 2)}D))", f"pow(power, 1 / {float(p or 2)}D)"
    if formula is None:
        raise ValueError(f"unknown metric {metric!r}")
    made = _entries(pairs, x, y).groupBy("i", "j").agg(*(F.expr(f).alias(name) for name, f in sums.items()))
    # pairs without an entry have no row there
    whole = pairs.join(made, ["i", "j"], "left").fillna(0.0, list(sums)).withColumn("n", F.lit(float(n)))
    return whole.select("i", "j", F.expr(formula).alias("d"))


def combine(pairs: DataFrame, x: DataFrame, y: DataFrame, how: str) -> DataFrame:
    """(i, j, idx, val): ``sum``, ``diff`` or ``mul`` of each pair of vectors, without zeros."""
    value: dict[str, Column] = {"sum": F.col("u") + F.col("v"), "diff": F.col("u") - F.col("v"), "mul": F.col("u") * F.col("v")}
    return _entries(pairs, x, y).select("i", "j", "idx", value[how].alias("val")).where("val != 0")


def index_sets(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, union, intersection): sorted index arrays of each pair that has entries."""
    made = _entries(pairs, x, y).groupBy("i", "j")
    both = F.expr("sort_array(collect_list(case when u != 0 and v != 0 then idx end))")
    return made.agg(F.sort_array(F.collect_list("idx")).alias("union"), both.alias("intersection"))


def pairwise(x: DataFrame, y: DataFrame, metric: str, n: int) -> DataFrame:
    """(i, j, d) of every vector of ``x`` with every one of ``y``; the pairs are asked for, so all are made.

    Blocks of entries meet blocks of entries, and what a pair needs is summed there: no entry of a pair is a row.
    """
    if metric not in ("euclidean", "sqeuclidean", "cosine", "manhattan", "jaccard_positive"):
        raise ValueError(f"unknown metric {metric!r}")
    x, y = (v.where("id is not null").selectExpr("id", "coalesce(cast(idx as long), -1) as idx", "coalesce(cast(val as double), 0D) as val") for v in (x, y))
    a, b = (max(1, math.ceil(v.count() / ENTRIES)) for v in (x, y))
    a = a if a * b >= blocks.BLOCKS else math.ceil(blocks.BLOCKS / b)
    return blocks.met(x, y, a, b, _pairs(metric), "i long, j long, d double")


def _vectors(side: blocks.Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first entry of each, idx, val); entries of one place are summed."""
    order = np.lexsort((side["idx"], side["id"]))
    ids, idx, val = side["id"][order], side["idx"][order], side["val"][order]
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (idx[1:] != idx[:-1]))))
    ids, idx, val = ids[new], idx[new], np.add.reduceat(val, new)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[first], first, idx, val


def _pairs(metric: str):
    def run(_: int, left: blocks.Side, right: blocks.Side) -> Iterator[pa.RecordBatch]:
        ids, first, idx, u = _vectors(left)
        others, start, places, w = _vectors(right)
        known, column = np.unique(places, return_inverse=True)
        at = np.minimum(np.searchsorted(known, idx), len(known) - 1)
        at = np.where(known[at] == idx, at, len(known))  # the last place is always 0
        uu, up = np.add.reduceat(u * u, first), np.add.reduceat((u > 0).astype(float), first)
        dense, waiting, many = np.zeros(len(known) + 1), [], 0
        for j, begin, end in zip(others, start, [*start[1:], len(w)], strict=True):
            dense[column[begin:end]] = w[begin:end]
            v, each = w[begin:end], dense[at]
            total = lambda f: np.add.reduceat(f, first)
            if metric == "cosine":
                vv, uv = (v * v).sum(), total(u * each)
                root = np.sqrt(uu * vv)
                d = np.where((uu == 0) & (vv == 0), 0.0, np.where((uu == 0) | (vv == 0), 1.0, 1 - uv / np.where(root > 0, root, 1)))
            elif metric == "manhattan":
                d = np.maximum(total(np.abs(u - each) - np.abs(each)) + np.abs(v).sum(), 0)
            elif metric == "jaccard_positive":
                both = total(((u > 0) & (each > 0)).astype(float))
                either = up + (v > 0).sum() - both
                d = np.where(either > 0, 1 - both / np.where(either > 0, either, 1), 0.0)
            else:
                d = np.maximum(total((u - each) ** 2 - each * each) + (v * v).sum(), 0)
                d = np.sqrt(d) if metric == "euclidean" else d
            dense[column[begin:end]] = 0
            for n in range(0, len(ids), ROWS):
                waiting.append((ids[n : n + ROWS], np.full(len(ids[n : n + ROWS]), j), d[n : n + ROWS]))
                many += len(waiting[-1][0])
                if many >= ROWS:
                    yield _batch(waiting)
                    waiting, many = [], 0
        if many:
            yield _batch(waiting)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip("ijd", map(np.concatenate, zip(*rows, strict=True)), strict=True)))


def sparsity(points: DataFrame) -> DataFrame:
    """One row (zeros, total, sparsity, is_sparse) of dense (id, features); sparse from half zeros on."""
    made = points.select(F.expr("size(filter(features, e -> e = 0))").alias("z"), F.size("features").alias("s")).agg(F.coalesce(F.sum("z"), F.lit(0)).alias("zeros"), F.coalesce(F.sum("s"), F.lit(0)).alias("total"))
    share = F.coalesce(F.expr("zeros / nullif(total, 0)"), F.lit(0.0))
    return made.select("zeros", "total", share.alias("sparsity"), (share >= 0.5).alias("is_sparse"))
