"""Set algebra, supervision, pruning and components of neighbour graphs (i, j, w); pairs occur once.

All of it is joins and aggregations on (i, j) or on i. An empty graph gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplexa.operators.common import dropped, written


def _either(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """(i, j, l, r): weights of both graphs, what is missing filled with half the graph's least weight, 1e-8 at least."""
    least = lambda g, name, *most: g.agg(F.greatest(F.least(F.min("w") / 2, *most) if most else F.min("w") / 2, F.lit(1e-8)).alias(name))
    both = left.select("i", "j", F.col("w").alias("l")).join(right.select("i", "j", F.col("w").alias("r")), ["i", "j"], how)
    low = F.broadcast(least(left, "low")).crossJoin(F.broadcast(least(right, "low0", F.lit(1e-4))))  # a row each
    return both.crossJoin(low)


def general_intersection(left: DataFrame, right: DataFrame, weight: float = 0.5, right_complement: bool = False) -> DataFrame:
    """(i, j, w): both graphs mixed, l * r ** (weight / (1 - weight)) or the mirror from one half on; with ``right_complement`` 1 - r on left's edges."""
    if right_complement:
        right = right.select("i", "j", (1 - F.col("w")).alias("w"))
    both = _either(left, right, "left" if right_complement else "full")
    l, r = F.coalesce("l", "low"), F.coalesce("r", "low0")
    raised = l * r ** (weight / (1 - weight)) if weight < 0.5 else l ** ((1 - weight) / weight) * r
    plain = F.coalesce("l", F.lit(0.0)) + (F.lit(0.0) if right_complement else F.coalesce("r", F.lit(0.0)))
    return both.select("i", "j", F.when((l > F.col("low")) | (r > F.col("low0")), raised).otherwise(plain).alias("w"))


def general_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, w): l + r - l * r of both graphs."""
    both = _either(left, right, "full")
    low0 = right.agg(F.greatest(F.min("w") / 2, F.lit(1e-8)).alias("low1"))
    left_w, right_w = F.coalesce("l", "low"), F.coalesce("r", "low1")
    return both.crossJoin(F.broadcast(low0)).select("i", "j", (left_w + right_w - left_w * right_w).alias("w"))


def _with_targets(graph: DataFrame, targets: DataFrame) -> DataFrame:
    a = targets.select(F.col("id").alias("i"), F.col("target").alias("ti"))
    return graph.join(a, "i").join(a.select(F.col("i").alias("j"), F.col("ti").alias("tj")), "j")


def categorical_intersection(graph: DataFrame, targets: DataFrame, unknown: float = 1.0, far: float = 5.0) -> DataFrame:
    """Weights times exp(-unknown) where a target (id, target) is -1 or null, exp(-far) where targets differ."""
    open_ = F.coalesce(F.col("ti") == -1, F.lit(True)) | F.coalesce(F.col("tj") == -1, F.lit(True))
    factor = F.when(open_, F.exp(F.lit(-unknown))).when(F.col("ti") != F.col("tj"), F.exp(F.lit(-far))).otherwise(1.0)
    return _with_targets(graph, targets).select("i", "j", (F.col("w") * factor).alias("w"))


def far_distance(target_weight: float) -> float:
    """How far apart different categories are taken to be in supervised fits."""
    return 2.5 / (1 - target_weight) if target_weight < 1 else 1e12


def metric_intersection(graph: DataFrame, targets: DataFrame, between: Column, scale: float = 1.0) -> DataFrame:
    """Weights times exp(-scale * between), a distance of the columns ``ti`` and ``tj``."""
    return _with_targets(graph, targets).select("i", "j", (F.col("w") * F.exp(-F.lit(float(scale)) * between)).alias("w"))


def reset_local_connectivity(graph: DataFrame) -> DataFrame:
    """Each point's weights over its largest, then a + b - ab of both directions; weights of 0 go."""
    own = graph.withColumn("w", F.col("w") / F.max("w").over(Window.partitionBy("i"))).where("w > 0")
    both = own.select("i", "j", F.col("w").alias("a"), F.lit(0.0).alias("b")).unionByName(own.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("a"), F.col("w").alias("b")))
    return both.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("i", "j", F.expr("a + b - a * b").alias("w"))


def prune(edges: DataFrame, most: float) -> DataFrame:
    """Edges (i, rank, j, dist) below the disconnection distance."""
    return edges.where(F.col("dist") < most)


def disconnected(points: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """(id): points all of whose edges the disconnection distance cuts."""
    return points.select("id").join(prune(edges, most).select(F.col("i").alias("id")), "id", "left_anti")


def mean_distance(edges: DataFrame) -> DataFrame:
    """(i, mean): mean distance of each point to its neighbours."""
    return edges.groupBy("i").agg(F.avg("dist").alias("mean"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, ``recall``: the share of the exact edges that ``found`` holds."""
    hit = exact.select("i", "j").join(found.select("i", "j").withColumn("hit", F.lit(1)), ["i", "j"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that the other end has too."""
    return edges.join(edges.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_semi")


def components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that a point can reach, by hooking to the least neighbour and halving paths.

    A point hooks itself and its component so far, so rounds grow with the logarithm of the longest
    chain. Each round is written to the session's checkpoint folder: a lost executor costs a round,
    and the planner sees the size of what is there. (A checkpoint keeps the size estimated for its
    plan, which each round's joins would square.)
    """
    both = written(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i != j").distinct())
    now = written(points.select("id", F.col("id").alias("component")))
    while True:
        reach = both.join(now.select(F.col("id").alias("j"), "component"), "j").groupBy(F.col("i").alias("id")).agg(F.min("component").alias("near"))
        step = now.join(reach, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("near"))
        hook = step.groupBy(F.col("was").alias("id")).agg(F.min("near").alias("hook"))
        step = written(step.join(hook, "id", "left").select("id", F.least("near", F.coalesce("hook", "near")).alias("component"), "was"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("to"))
        after = written(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("to", "component")).alias("component"), "was"))
        dropped(now, step)
        now = after
        if after.where("component != was").isEmpty():
            dropped(both)
            return after.select("id", "component")
