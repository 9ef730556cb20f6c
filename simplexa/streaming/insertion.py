"""Out-of-sample placement and streaming insertion of points into an embedding.

A model is a table (id, features, embedding). New points go to the weighted mean of the
embeddings of their k nearest points of the model; ``distance`` weighs by 1 / (dist + 1e-10),
``uniform`` alike. Ids of new points must not occur in the model (a point is never its own
neighbour). An empty model or batch gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from simplexa.operators.neighbors import knn


def interpolate(model: DataFrame, new: DataFrame, k: int = 5, weights: str = "distance") -> DataFrame:
    """(id, features, embedding) of the points ``new`` (id, features)."""
    if weights not in ("distance", "uniform"):
        raise ValueError(f"unknown weights {weights!r}")
    near = knn(new.select("id", "features"), k, base=model.select("id", "features"))
    w = 1 / (F.col("dist") + 1e-10) if weights == "distance" else F.lit(1.0)
    each = near.select("i", "j", w.alias("w")).join(model.select(F.col("id").alias("j"), F.posexplode("embedding").alias("dim", "y")), "j")
    mean = each.groupBy("i", "dim").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))
    made = mean.groupBy("i").agg(F.expr("transform(array_sort(collect_list(struct(dim, y))), e -> e.y)").alias("embedding"))
    return new.select("id", "features").join(made.withColumnRenamed("i", "id"), "id").select("id", "features", "embedding")


class StreamingEmbedding:
    """A growing model in a folder of parquet files, one sub-folder for each batch; a batch that is repeated replaces itself."""

    def __init__(self, spark: SparkSession, path: str, k: int = 5, weights: str = "distance") -> None:
        self.spark, self.path, self.k, self.weights = spark, path.rstrip("/"), k, weights

    def fit(self, points: DataFrame, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Embed ``points`` (id, features) by ``reduce``, which returns (id, features) in the embedding."""
        made = points.select("id", "features").join(reduce(points).select("id", F.col("features").alias("embedding")), "id")
        made.write.mode("overwrite").parquet(f"{self.path}/batch=0")
        return self.embedding()

    def embedding(self, before: int | None = None) -> DataFrame:
        """(id, features, embedding) of all points so far, or of the batches before one."""
        held = self.spark.read.parquet(self.path)
        return (held if before is None else held.where(F.col("batch") < before)).select("id", "features", "embedding")

    def transform(self, new: DataFrame) -> DataFrame:
        """Place points without adding them."""
        return interpolate(self.embedding(), new, self.k, self.weights)

    def partial_fit(self, new: DataFrame, batch: int) -> DataFrame:
        """Place points by all earlier batches, add them as batch 1, 2, ... and return the whole embedding."""
        if batch < 1:
            raise ValueError("batches count from 1")
        interpolate(self.embedding(batch), new, self.k, self.weights).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self.embedding()

    def attach(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Insert a stream (id, features), a micro-batch at a time; a batch replayed after a failure replaces itself."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.partial_fit(df, n + 1) and None).start()
