"""Registered queries of the engine and their DuckDB twins (written independently, over unnested rows)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexa.functions.distances import EXPRESSIONS, distance
from simplexa.operators import neighbors, quality
from simplexa.operators.common import settle
from simplexa.plans import more
from simplexa.plans.base import AGGREGATES, DOMAIN, Query, flat, knn_sql, points


def pair_distance(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Distance of every point to the next one by id."""
    coordinate = f"transform(features, e -> cast({DOMAIN.get(name, '{0}').format('e')} as double))"
    rows = points(spark, sf_dir).select("id", F.expr(coordinate).alias("x"))
    later = rows.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return rows.join(later, "id").select("id", F.round(distance(name, "x", "y", 3.0), 6).alias("d"))


def knn_exact(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    found = neighbors.knn(points(spark, sf_dir).select("id", "features"), 10, metric)
    return found.select("i", F.col("rank").cast("long").alias("rank"), "j", F.round("dist", 6).alias("dist"))


def neighbor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = neighbors.knn(points(spark, sf_dir).select("id", "features"), 15)
    low = neighbors.knn(flat(spark, sf_dir).select("id", "features"), 15)
    return quality.neighbor_overlap(high, low, 15).select(F.round("overlap", 6).alias("overlap"))


def global_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.global_structure(points(spark, sf_dir), flat(spark, sf_dir)).select(F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy neighbour graph: kNN, local scale, membership, union."""
    edges = settle(neighbors.knn(points(spark, sf_dir).select("id", "features"), 14))
    graph = neighbors.fuzzy_union(neighbors.membership(edges, neighbors.local_scale(edges, 15)))
    return graph.select("i", "j", F.round("w", 4).alias("w"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"dist_{name}": partial(pair_distance, name=name) for name in [*EXPRESSIONS, "minkowski"]}
    found |= {f"knn_exact_{m}": partial(knn_exact, metric=m) for m in ("euclidean", "manhattan", "chebyshev", "cosine")}
    return found | {"fuzzy_graph": flagship, "neighbor_overlap": neighbor_overlap, "global_structure": global_structure} | more.queries()


def _pairs(name: str) -> str:
    u, v = (DOMAIN.get(name, "{0}").format(f"CAST({c} AS DOUBLE)") for c in ("u", "v"))
    return f"""WITH raw AS (SELECT a.vec_id AS id, unnest(a.embedding) AS u, unnest(b.embedding) AS v, unnest(range(1, len(a.embedding) + 1)) AS k
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), p AS (SELECT id, k, {u} AS u, {v} AS v FROM raw)"""


def oracle_sql() -> dict[str, str]:
    out = {f"dist_{name}": f"{_pairs(name)} SELECT id, round(CAST({agg} AS DOUBLE), 6) AS d FROM p GROUP BY id" for name, agg in AGGREGATES.items()}
    out["dist_symmetric_kl"] = f"""{_pairs('symmetric_kl')}, n AS (SELECT id, (u + 1e-11) / sum(u + 1e-11) OVER (PARTITION BY id) AS u, (v + 1e-11) / sum(v + 1e-11) OVER (PARTITION BY id) AS v FROM p)
 SELECT id, round(0.5 * sum(u*ln(u/v) + v*ln(v/u)), 6) AS d FROM n GROUP BY id"""
    out |= {f"knn_exact_{m}": f"SELECT i, rank, j, round(dist, 6) AS dist FROM ({knn_sql(m, 10)})" for m in ("euclidean", "manhattan", "chebyshev", "cosine")}
    out["neighbor_overlap"] = f"""WITH h AS ({knn_sql('euclidean', 15)}), l AS ({knn_sql('euclidean', 15, 'AND a.k <= 2')})
 SELECT round((SELECT count(*) FROM h JOIN l USING (i, j)) / (15.0 * (SELECT count(*) FROM embeddings)), 6) AS overlap"""
    out["global_structure"] = """WITH c AS (SELECT label, k, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY 1, 2),
 d AS (SELECT a.label, b.label AS other, sqrt(sum(pow(a.m-b.m, 2))) AS h, sqrt(sum(pow(a.m-b.m, 2)) FILTER (a.k <= 2)) AS l FROM c a JOIN c b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2)
 SELECT round(greatest(coalesce(corr(h, l), 1.0), 0.0), 6) AS score FROM d"""
    out["fuzzy_graph"] = f"""WITH RECURSIVE h AS ({knn_sql('euclidean', 14)}), s AS (SELECT i, list(dist ORDER BY dist) AS ds, coalesce(min(dist) FILTER (dist > 0), 0) AS rho FROM h GROUP BY i),
 r AS (SELECT i, ds, rho, 0 AS step, 0.0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1.0::DOUBLE AS mid, false AS done FROM s
  UNION ALL SELECT i, ds, rho, step + 1, CASE WHEN done OR t > log2(15) THEN low ELSE mid END, CASE WHEN done OR t <= log2(15) THEN high ELSE mid END,
   CASE WHEN done THEN mid WHEN t > log2(15) THEN (low + mid) / 2 WHEN isinf(high) THEN mid * 2 ELSE (mid + high) / 2 END, done
  FROM (SELECT i, ds, rho, step, low, high, mid, t, abs(t - log2(15)) < 1e-5 AS done FROM (SELECT *, list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0) / mid))) AS t FROM r WHERE step < 64))),
 f AS (SELECT i, greatest(mid, 1e-3 * list_sum(ds) / 15) AS sigma, rho FROM r WHERE step = 64),
 w AS (SELECT h.i, h.j, exp(-greatest(dist - rho, 0) / sigma) AS w FROM h JOIN f USING (i)), t AS (SELECT j AS i, i AS j, w FROM w)
 SELECT i, j, round(coalesce(w.w, 0) + coalesce(t.w, 0) - coalesce(w.w, 0) * coalesce(t.w, 0), 4) AS w FROM w FULL JOIN t USING (i, j)"""
    return out | more.oracle_sql()
