"""Fusion of dense and sparse results (qid, indexid, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    return dense.select("qid", "indexid", "score", F.lit(0).alias("side")).unionByName(sparse.select("qid", "indexid", "score", F.lit(1).alias("side")))


def _weights(weights: float | tuple[float, float]) -> tuple[float, float]:
    return (weights, 1 - weights) if isinstance(weights, (int, float)) else tuple(weights)


def convex(dense: DataFrame, sparse: DataFrame, weights: float | tuple[float, float] = 0.5) -> DataFrame:
    """Weighted sum of scores."""
    a, b = _weights(weights)
    w = F.when(F.col("side") == 0, F.lit(float(a))).otherwise(F.lit(float(b)))
    return _both(dense, sparse).groupBy("qid", "indexid").agg(F.sum(F.col("score") * w).alias("score"))


def reciprocal(dense: DataFrame, sparse: DataFrame, weights: float | tuple[float, float] = 0.5) -> DataFrame:
    """Weighted sum of 1 / rank, ranks from 1 within each side."""
    a, b = _weights(weights)
    w = F.when(F.col("side") == 0, F.lit(float(a))).otherwise(F.lit(float(b)))
    rank = F.row_number().over(Window.partitionBy("qid", "side").orderBy(F.desc(F.round("score", 9)), "indexid"))
    return _both(dense, sparse).withColumn("rank", rank).groupBy("qid", "indexid").agg(F.sum(w / F.col("rank")).alias("score"))


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))


def log_odds(dense: DataFrame, sparse: DataFrame, weights: float | tuple[float, float] = 0.5) -> DataFrame:
    """Sigmoid of the weighted sum of log-odds, times the root of 2 where both sides found the row.

    Dense scores are first calibrated by the upper median and the deviation of the positive ones;
    sparse scores are probabilities already.
    """
    a, b = _weights(weights)
    w = Window.partitionBy("qid")
    positive = F.when(F.col("score") > 0, F.col("score"))
    middle = F.sort_array(F.collect_list(positive).over(w))
    d = dense.withColumn("mid", F.coalesce(F.try_element_at(middle, F.floor(F.size(middle) / 2).cast("int") + 1), F.lit(0.0))).withColumn("sd", F.stddev_pop(positive).over(w))
    d = d.select("qid", "indexid", _clip((F.col("score") - F.col("mid")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))).alias("d"))
    p = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), F.col("score")))
    s = sparse.select("qid", "indexid", _clip(F.log(p / (1 - p))).alias("s"))
    both = d.join(s, ["qid", "indexid"], "full_outer")
    total = F.coalesce(F.col("d") * a, F.lit(0.0)) + F.coalesce(F.col("s") * b, F.lit(0.0))
    n = F.when(F.col("d").isNotNull() & F.col("s").isNotNull(), F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0))
    return both.select("qid", "indexid", (1 / (1 + F.exp(-_clip(total * n)))).alias("score"))
