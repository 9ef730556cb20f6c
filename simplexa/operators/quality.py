"""How well an embedding keeps its points' neighbourhoods and groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from simplexa.functions.distances import distance
from simplexa.operators import blocks, neighbors
from simplexa.operators.common import written


def neighbor_overlap(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """One row, ``overlap``: the share of the k-neighbour edges that both edge tables hold."""
    points = high.agg(F.count_distinct("i").alias("n"))
    shared = high.select("i", "j").join(low.select("i", "j"), ["i", "j"]).agg(F.count("*").alias("c"))
    return shared.crossJoin(points).select((F.col("c") / (F.col("n") * k)).alias("overlap"))  # a row each


def centroids(points: DataFrame) -> DataFrame:
    """(label, dim, value): mean of every coordinate by label."""
    return points.select("label", F.posexplode("features").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("value"))


def global_structure(high: DataFrame, low: DataFrame) -> DataFrame:
    """One row, ``score``: Pearson correlation of the centroids' distances in both spaces, at least 0; 1 if undefined."""

    def between(points: DataFrame, name: str) -> DataFrame:
        a = centroids(points)
        b = a.select(F.col("label").alias("other"), "dim", F.col("value").alias("v"))
        return a.join(b, "dim").where("label < other").groupBy("label", "other").agg(F.sqrt(F.sum((F.col("value") - F.col("v")) ** 2)).alias(name))

    both = between(high, "a").join(between(low, "b"), ["label", "other"])
    r = F.corr("a", "b")
    return both.agg(F.when(r.isNull() | F.isnan(r), 1.0).otherwise(F.greatest(r, F.lit(0.0))).alias("score"))


def pair_distances(high: DataFrame, low: DataFrame, block_rows: int = 1024) -> DataFrame:
    """(i, j, a, b): Euclidean distances of all pairs i < j of (id, features) in both spaces, block against block.

    Quadratic in the points by definition; for large tables pass a sample.
    """
    both = high.select("id", F.col("features").alias("x")).join(low.select("id", F.col("features").alias("y")), "id")
    m = max(1, -(-high.count() // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(m))
    each = both.withColumn("s", block).select("id", "x", "y", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("t"))
    each = each.select("id", "x", "y", "s", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"))
    return each.groupBy("p", "q").applyInPandas(_block_pairs, "i long, j long, a double, b double")


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    p, q = rows["p"].iloc[0], rows["q"].iloc[0]
    left = rows[rows["s"] == p]
    right = rows[rows["s"] == q]
    ids, other = left["id"].to_numpy(), right["id"].to_numpy()
    out = []
    for at in range(0, len(ids), 64):
        d = [np.sqrt(((np.stack(left[c].iloc[at : at + 64])[:, None] - np.stack(right[c])[None]) ** 2).sum(-1)) for c in ("x", "y")] if len(other) else None
        if d is None:
            continue
        i, j = np.meshgrid(ids[at : at + 64], other, indexing="ij")
        ok = i < j if p == q else i != j
        out.append(pd.DataFrame({"i": np.minimum(i, j)[ok], "j": np.maximum(i, j)[ok], "a": d[0][ok], "b": d[1][ok]}))
    return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "a": [], "b": []}).astype({"i": "int64", "j": "int64"})


def average_rank(rows: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """``rows`` with the rank of ``column`` (ties share their mean) as ``<column>_rank``.

    Ranks are counted within equal-width buckets and moved up by the counts of the buckets below, so no task sorts all rows.
    """
    least, most = rows.agg(F.min(column), F.max(column)).first()
    width = ((most or 0) - (least or 0)) / buckets or 1.0
    put = rows.withColumn("_bucket", F.least(F.floor((F.col(column) - F.lit(least or 0.0)) / width), F.lit(buckets - 1)))
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offset = put.groupBy("_bucket").agg(F.count("*").alias("_m")).select("_bucket", F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_below"))
    inside, equal = Window.partitionBy("_bucket").orderBy(column), Window.partitionBy("_bucket", column)
    rank = F.col("_below") + F.rank().over(inside) + (F.count("*").over(equal) - 1) / 2
    return put.join(F.broadcast(offset), "_bucket").withColumn(f"{column}_rank", rank).drop("_bucket", "_below")


def spearman(pairs: DataFrame) -> DataFrame:
    """One row, ``rho``: rank correlation of the distances a and b of (i, j, a, b)."""
    return average_rank(average_rank(pairs, "a"), "b").agg(F.corr("a_rank", "b_rank").alias("rho"))


def density_preservation(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """One row, ``score``: correlation of the densities 1 / mean distance of k neighbours, the point itself among them; at least 0, 1 if undefined."""
    of = lambda edges, name: edges.where(F.col("rank") < k).groupBy("i").agg((1 / (F.sum("dist") / k + 1e-10)).alias(name))
    r = F.corr("a", "b")
    return of(high, "a").join(of(low, "b"), "i").agg(F.when(r.isNull() | F.isnan(r), 1.0).otherwise(F.greatest(r, F.lit(0.0))).alias("score"))


def rank_trustworthiness(high: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """(k, score) for k = 1..most: neighbours in the embedding ``low`` pay by how far beyond k they rank in the source ``high`` (id, features).

    A neighbour's rank is counted against all points, block by block; no table of pairs or ranks is made.
    """
    both = written(high.select("id", "features").join(low.select("id", F.col("features").alias("y")), "id").where("features is not null and y is not null"))
    x, edges = both.select("id", "features"), neighbors.knn(both.select("id", F.col("y").alias("features")), most)
    near = edges.groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "j"))).alias("l"))
    pad = F.expr(f"concat(transform(l, e -> e.j), array_repeat(-1L, {most} - size(l)))").alias("near")
    left = written(x.join(near.select("id", pad), "id"))
    n, rows = blocks.count(x)
    far = blocks.crossed(left, x, n, n, rows, _given_pairs, _gathered_pairs, "id long, far array<double>")
    left = left.join(far, "id").select("id", "features", "near", "far")
    paid = blocks.crossed(left, x, n, n, rows, _below, _paid(most), "k long, paid long").groupBy("k").agg(F.sum("paid").alias("paid"))
    score = 1 - F.col("paid") * 2 / (F.lit(rows) * F.col("k") * (2 * F.lit(rows) - 3 * F.col("k") - 1))
    return paid.select("k", score.alias("score"))


def _given_pairs(left: blocks.Side, right: blocks.Side) -> tuple[blocks.Side, blocks.Side]:
    """Distances of the pairs (id, near) whose second point is a right one."""
    near, there = left["near"], right["id"]
    at = np.minimum(np.searchsorted(there, near), len(there) - 1)
    row, col = np.nonzero(there[at] == near)
    far = np.full(near.shape, np.inf)
    far[row, col] = neighbors.measure("euclidean", left["features"], right["features"])(row, at[row, col])
    return {"far": far}, {}


def _gathered_pairs(ids: np.ndarray, found: list[blocks.Side]) -> dict:
    far = np.minimum.reduce([f[0] for f in found])
    return {"id": ids, "far": pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * far.shape[1], far.ravel())}


def _below(left: blocks.Side, right: blocks.Side) -> tuple[blocks.Side, blocks.Side]:
    """How many right points come before each of a left point's neighbours, by distance and id; what the screen leaves open is measured."""
    x, y, near, far, other = left["features"], right["features"], left["near"], left["far"], right["id"]
    screen, measure = neighbors.Products(x, y, "euclidean"), neighbors.measure("euclidean", x, y)
    own = np.minimum(np.searchsorted(other, left["id"]), len(other) - 1)
    own = np.where(other[own] == left["id"], own, -1)
    out = np.zeros(near.shape, np.int64)
    for r in range(0, len(x), screen.rows):
        rows = slice(r, r + screen.rows)
        for c in range(0, len(y), screen.columns):
            s = screen.tile(rows, slice(c, c + screen.columns))
            mine = np.flatnonzero((own[rows] >= c) & (own[rows] < c + len(s)))
            s[own[rows][mine] - c, mine] = np.inf
            for t in range(near.shape[1]):
                most = far[rows, t]
                surely, open_ = s < screen.limit(most, rows, below=True), s <= screen.limit(most, rows)
                for at in range(0, len(s), 64):  # so few that a byte holds the count
                    out[rows, t] += np.add.reduce(surely[at : at + 64].view(np.int8), axis=0, dtype=np.int8)
                col, row = np.divmod(neighbors.hits(open_ ^ surely), s.shape[1])
                if len(row):
                    d = measure(row + r, col + c)
                    less = (d < most[row]) | ((d == most[row]) & (other[col + c] < near[rows, t][row]))
                    np.add.at(out[rows, t], row[less], 1)
    return {"near": near, "below": out}, {}


def _paid(most: int):
    """(k, paid) of a slice."""

    def run(ids: np.ndarray, found: list[blocks.Side]) -> dict[str, np.ndarray]:
        source, there = 1 + sum(f[1] for f in found), found[0][0] >= 0
        k = np.arange(1, most + 1)
        return {"k": k, "paid": np.array([np.where(there[:, :n], np.maximum(source[:, :n] - n, 0), 0).sum() for n in k])}

    return run


def penalised_overlap(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """One row, ``score``: 1 less a penalty for each neighbour in ``low`` that ``high`` lacks (as if it ranked k + 1 there); 0 to 1. Swap the graphs for continuity."""
    missing = low.join(high.select("i", "j"), ["i", "j"], "left_anti").agg(F.count("*").alias("c"))
    n = F.col("n")
    score = 1 - F.lit(2) / (n * k * (2 * n - 3 * k - 1)) * F.col("c")
    return missing.crossJoin(low.agg(F.count_distinct("i").alias("n"))).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def local_continuity(high: DataFrame, low: DataFrame) -> DataFrame:
    """One row, ``score``: mean over points of the rank correlation of both distances to the neighbours in ``high``.

    ``high`` is an edge table (i, rank, j, dist), ``low`` the points (id, features) of the embedding; undefined points are passed over.
    """
    y = low.select(F.col("id").alias("i"), F.col("features").alias("x"))
    each = high.join(y, "i").join(y.select(F.col("i").alias("j"), F.col("x").alias("y")), "j").withColumn("d", distance("euclidean", "x", "y"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("d", "rank")))
    r = ranked.groupBy("i").agg(F.corr("rank", "place").alias("r"))
    return r.where("r is not null and not isnan(r)").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("score"))


def neighborhood_jaccard(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """(i, jaccard): shared over all neighbours of each point."""
    shared = high.select("i", "j").join(low.select("i", "j").withColumn("hit", F.lit(1)), ["i", "j"], "left").groupBy("i").agg(F.count("hit").alias("c"))
    return shared.select("i", (F.col("c") / (2 * k - F.col("c"))).alias("jaccard"))


def distance_histogram(means: DataFrame, bins: int = 25) -> DataFrame:
    """(bin, n): how many of the values ``mean`` fall in each of equal-width bins from the least to the largest."""
    ends = means.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    at = F.least(F.floor((F.col("mean") - F.col("low")) / F.expr("nullif(high - low, 0D)") * bins), F.lit(bins - 1))
    return means.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def clustering_agreement(rows: DataFrame) -> DataFrame:
    """One row (ari, nmi) of the labellings u and v of ``rows``; nmi by the arithmetic mean of the entropies."""
    cell = rows.groupBy("u", "v").agg(F.count("*").cast("double").alias("n"))
    two = lambda n: F.sum(n * (n - 1) / 2)
    log = lambda n: F.sum(n * F.log(n))
    made = cell.agg(two(F.col("n")).alias("c"), log(F.col("n")).alias("h"), F.sum("n").alias("total"))
    for side in ("u", "v"):
        marginal = cell.groupBy(side).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias(f"c{side}"), log(F.col("n")).alias(f"h{side}"))
        made = made.crossJoin(marginal)  # a row each
    return made.select(
        F.expr("coalesce((c - cu * cv / (total * (total - 1) / 2)) / nullif((cu + cv) / 2 - cu * cv / (total * (total - 1) / 2), 0D), 1D)").alias("ari"),
        F.expr("coalesce((ln(total) + (h - hu - hv) / total) / nullif((2 * ln(total) - (hu + hv) / total) / 2, 0D), 1D)").alias("nmi"),
    )


def separation(points: DataFrame) -> DataFrame:
    """One row (calinski_harabasz, davies_bouldin) of the groups of (id, features, label), by their centroids."""
    each = points.select("id", "label", F.posexplode("features").alias("dim", "x"))
    centre = each.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    grand = each.groupBy("dim").agg(F.avg("x").alias("g"))
    off = each.join(centre, ["label", "dim"]).groupBy("id", "label").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("s"))
    group = off.groupBy("label").agg(F.count("*").alias("n"), F.sum("s").alias("within"), F.avg(F.sqrt("s")).alias("spread"))
    between = centre.join(grand, "dim").groupBy("label").agg(F.sum((F.col("m") - F.col("g")) ** 2).alias("gap"))
    score = group.join(between, "label").agg((F.sum(F.col("n") * F.col("gap")) / (F.count("*") - 1) / (F.sum("within") / (F.sum("n") - F.count("*")))).alias("calinski_harabasz"))
    other = centre.select(F.col("label").alias("other"), "dim", F.col("m").alias("m0"))
    apart = centre.join(other, "dim").where("label != other").groupBy("label", "other").agg(F.sqrt(F.sum((F.col("m") - F.col("m0")) ** 2)).alias("d"))
    spread = group.select("label", "spread")
    worst = apart.join(spread, "label").join(spread.select(F.col("label").alias("other"), F.col("spread").alias("spread0")), "other").groupBy("label").agg(F.max((F.col("spread") + F.col("spread0")) / F.col("d")).alias("w"))
    return score.crossJoin(worst.agg(F.avg("w").alias("davies_bouldin")))  # a row each


def silhouette(points: DataFrame) -> DataFrame:
    """One row, ``score``: mean silhouette of (id, features, label); points alone in their group or without a label count 0.

    Each pair of blocks sums its distances by label; what is shuffled is the points times the labels.
    """
    kind = F.col("label").cast("long") if isinstance(points.schema["label"].dataType, IntegralType) else F.xxhash64("label")
    left = points.select("id", "features", F.coalesce(kind, F.lit(0)).alias("kind"), F.when(F.col("label").isNull(), 0).otherwise(1).cast("long").alias("known"))
    right = left.where("known = 1").select("id", "features", "kind")
    a, rows = blocks.count(left)
    made = blocks.crossed(left, right, a, blocks.count(right)[0], rows, _label_sums, _silhouettes, "s double, n long") if rows > 1 else points.selectExpr("0D as s", "0L as n").limit(0)
    # points that meet no labelled one have no row
    return made.agg(F.when(F.lit(rows) > 1, F.coalesce(F.sum("s"), F.lit(0.0)) / F.lit(max(rows, 1))).alias("score"))


def _label_sums(left: blocks.Side, right: blocks.Side) -> tuple[blocks.Side, blocks.Side]:
    """Sums of each left point's distances to the right points of every label; close ones, for which a product lacks digits, are measured."""
    order = np.argsort(right["kind"], kind="stable")
    kinds, start, size = np.unique(right["kind"][order], return_index=True, return_counts=True)
    x, y = left["features"], right["features"][order]
    measure = neighbors.measure("euclidean", x, y)
    centre = y.mean(0)
    u, v = x - centre, y - centre
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    out = np.zeros((len(x), len(kinds)))
    for r in range(0, len(x), 256):
        for c in range(0, len(y), 2048):
            norms = uu[r : r + 256, None] + vv[None, c : c + 2048]
            d = norms - 2 * (u[r : r + 256] @ v[c : c + 2048].T)
            row, col = np.divmod(neighbors.hits(d <= 1e-4 * norms), d.shape[1])
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            d[row, col] = measure(row + r, col + c)
            first = np.searchsorted(start, c, "right") - 1
            cuts = np.maximum(start[first : np.searchsorted(start, c + d.shape[1])] - c, 0)
            out[r : r + 256, first : first + len(cuts)] += np.add.reduceat(d, cuts, axis=1)
    return {"kind": left["kind"], "known": left["known"], "sums": out}, {"kinds": kinds, "sizes": size}


def _silhouettes(ids: np.ndarray, found: list[blocks.Side]) -> dict[str, np.ndarray]:
    kind, known = found[0][0], found[0][1]
    kinds = np.unique(np.concatenate([f[3] for f in found]))
    sums, sizes = np.zeros((len(ids), len(kinds))), np.zeros(len(kinds), np.int64)
    for f in found:
        at = np.searchsorted(kinds, f[3])
        sums[:, at] += f[2]
        sizes[at] += f[4]
    mine = (kinds[None] == kind[:, None]) & (known[:, None] == 1)
    many = sizes[None] - mine
    mean = np.where(many > 0, sums / np.maximum(many, 1), np.inf)
    own, other = np.where(mine, mean, np.inf).min(1), np.where(mine, np.inf, mean).min(1)
    fine = np.isfinite(own) & np.isfinite(other) & (np.maximum(own, other) > 0)
    own, other = own[fine], other[fine]
    return {"s": np.array([((other - own) / np.maximum(own, other)).sum()]), "n": np.array([len(ids)])}


def reconstruction(high: DataFrame, low: DataFrame) -> DataFrame:
    """One row (mse, rmse, normalized_rmse, relative_rmse, r2): least squares of the source's coordinates on the embedding's.

    One pass gathers moments a partition (the square of the dimensions); only their sum comes to the driver.
    """
    both = high.select("id", F.col("features").alias("x")).join(low.select("id", F.col("features").alias("y")), "id").select("x", "y")
    parts = both.mapInPandas(_moments, "part binary, size int").collect()
    if not parts:
        return high.sparkSession.createDataFrame([], "mse double, rmse double, normalized_rmse double, relative_rmse double, r2 double")
    width = parts[0]["size"]
    m = sum(np.frombuffer(p["part"]).reshape(width + 1, -1) for p in parts)
    yy, yx, xx, norms = m[:width, :width], m[:width, width:], m[width, width:], m[width, 0]
    n, d = yy[0, 0], yx.shape[1]
    rest = float((xx - (yx * np.linalg.lstsq(yy, yx, rcond=None)[0]).sum(0)).sum())
    mse, mean = max(rest, 0.0) / (n * d), yx[0].sum() / (n * d)
    std, total = np.sqrt(xx.sum() / (n * d) - mean**2), float((xx - yx[0] ** 2 / n).sum())
    row = (mse, np.sqrt(mse), np.sqrt(mse) / std if std > 0 else 0.0, np.sqrt(mse) / (norms / n) if norms > 0 else 0.0, 1 - rest / total if total > 0 else 0.0)
    return high.sparkSession.createDataFrame([tuple(map(float, row))], "mse double, rmse double, normalized_rmse double, relative_rmse double, r2 double")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for batch in batches:
        if not len(batch):
            continue
        x = np.stack(batch["x"]).astype(float)
        y = np.column_stack((np.ones(len(x)), np.stack(batch["y"]).astype(float)))
        w = y.shape[1]
        held = np.zeros((w + 1, w + x.shape[1])) if held is None else held
        held[:w, :w] += y.T @ y
        held[:w, w:] += y.T @ x
        held[w, w:] += (x * x).sum(0)
        held[w, 0] += np.sqrt((x * x).sum(1)).sum()
    if held is not None:
        yield pd.DataFrame({"part": [held.tobytes()], "size": [len(held) - 1]})
