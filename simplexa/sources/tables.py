"""Points from parquet, CSV or JSON; metric tables and embeddings to them; models as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexa.operators.linear import PCA


def read_points(spark: SparkSession, path: str, kind: str = "parquet", id_column: str | None = None, features: str | Sequence[str] | None = None) -> DataFrame:
    """(id, features): an array column, or several numeric columns side by side (all but the id where none are named).

    CSV has a header and its types are inferred; rows with a null coordinate are dropped.
    """
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    rows = spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.format(kind).load(path)
    id_column = id_column or rows.columns[0]
    if isinstance(features, str):
        made = F.col(features).cast("array<double>")
    else:
        made = F.array(*(F.col(f"`{c}`").cast("double") for c in features or [c for c in rows.columns if c != id_column]))
    out = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), made.alias("features"))
    return out.where("features is not null and forall(features, e -> e is not null)")


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A metric table or an embedding; arrays are written to CSV as JSON text."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "csv":
        df = df.select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes))
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def save_model(spark: SparkSession, model: PCA, path: str) -> None:
    """One JSON row, in whatever store Spark writes to."""
    row = {name: np.asarray(getattr(model, name)).tolist() for name in ("components", "explained_variance", "explained_variance_ratio", "mean")}
    spark.createDataFrame([(json.dumps(row),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> PCA:
    return PCA(**{name: np.array(x) for name, x in json.loads(spark.read.text(path).first()[0]).items()})
