"""What the query modules share: the points, a fixed embedding, and DuckDB building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: What a metric's domain needs done to a coordinate.
DOMAIN = {
    **{name: "abs({0})" for name in ("hellinger", "symmetric_kl")},
    "poincare": "0.5 * {0}",
    **{name: "CASE WHEN {0} > 0 THEN 1.0 ELSE 0.0 END" for name in ("hamming", "jaccard", "matching", "dice", "kulsinski", "rogerstanimoto", "russellrao", "sokalmichener", "sokalsneath", "yule")},
}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed two-dimensional embedding: the first two coordinates."""
    return points(spark, sf_dir).select("id", F.slice("features", 1, 2).alias("features"), "label")


_TT, _TF, _FT = "sum(CASE WHEN u<>0 AND v<>0 THEN 1 ELSE 0 END)", "sum(CASE WHEN u<>0 AND v=0 THEN 1 ELSE 0 END)", "sum(CASE WHEN u=0 AND v<>0 THEN 1 ELSE 0 END)"
_NE, _N = f"({_TF} + {_FT})", "count(*)"
_COSINE = "1 - sum(u*v) / sqrt(sum(u*u) * sum(v*v))"
AGGREGATES = {
    "euclidean": "sqrt(sum((u-v)*(u-v)))",
    "manhattan": "sum(abs(u-v))",
    "chebyshev": "max(abs(u-v))",
    "minkowski": "pow(sum(pow(abs(u-v), 3)), 1.0/3)",
    "canberra": "sum(CASE WHEN abs(u)+abs(v) > 0 THEN abs(u-v)/(abs(u)+abs(v)) ELSE 0 END)",
    "braycurtis": "coalesce(sum(abs(u-v)) / nullif(sum(abs(u+v)), 0), 0)",
    "cosine": _COSINE,
    "correlation": "1 - corr(u, v)",
    "hellinger": "sqrt(greatest(1 - sum(sqrt(u*v)) / sqrt(sum(u)*sum(v)), 0))",
    "poincare": "acosh(1 + 2*sum((u-v)*(u-v)) / ((1-sum(u*u))*(1-sum(v*v))))",
    "haversine": "2*asin(sqrt(pow(sin((min(u) FILTER (k=1) - min(v) FILTER (k=1))/2), 2) + cos(min(u) FILTER (k=1))*cos(min(v) FILTER (k=1))*pow(sin((min(u) FILTER (k=2) - min(v) FILTER (k=2))/2), 2)))",
    "hamming": f"{_NE} / {_N}",
    "jaccard": f"coalesce({_NE} / nullif({_TT} + {_NE}, 0), 0)",
    "matching": f"{_NE} / {_N}",
    "dice": f"coalesce({_NE} / nullif(2*{_TT} + {_NE}, 0), 0)",
    "kulsinski": f"CASE WHEN {_NE} = 0 THEN 0 ELSE ({_NE} - {_TT} + {_N}) / ({_NE} + {_N}) END",
    "rogerstanimoto": f"2*{_NE} / ({_N} + {_NE})",
    "russellrao": f"CASE WHEN {_NE} = 0 THEN 0 ELSE ({_N} - {_TT}) / {_N} END",
    "sokalmichener": f"2*{_NE} / ({_N} + {_NE})",
    "sokalsneath": f"CASE WHEN {_NE} = 0 THEN 0 ELSE {_NE} / (0.5*{_TT} + {_NE}) END",
    "yule": f"CASE WHEN {_TF} = 0 OR {_FT} = 0 THEN 0 ELSE 2*{_TF}*{_FT} / ({_TT}*({_N}-{_TT}-{_NE}) + {_TF}*{_FT}) END",
}


def knn_sql(metric: str, k: int, dims: str = "") -> str:
    """Edges by brute force over unnested coordinates."""
    return f"""SELECT i, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank, j, dist FROM (
 SELECT a.vec_id AS i, b.vec_id AS j, {AGGREGATES[metric]} AS dist
 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS u, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) a
 JOIN (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) b ON a.k = b.k AND a.vec_id <> b.vec_id {dims}
 GROUP BY 1, 2) QUALIFY rank <= {k}"""
