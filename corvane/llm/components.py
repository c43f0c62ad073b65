"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import release, stage


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least ``v`` of each ``u``, combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to (node, root): for every node its component's least node, for nodes other than it.

    Each round finds the least neighbours by a partial aggregation and joins
    them to the narrow edges; a hub's edges are a skewed key of that join, which
    Spark splits, and no task sees them all. Rounds are written to the shared
    folder, so the plan stays short, and the round before is deleted. The number
    of rounds grows with the logarithm of a component's size.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        around = _least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("far")).join(around, "u").select(F.col("far").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.join(_least(large), "u")
        small = low.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = stage(small.where("u <> v").distinct(), "edges")
        release(e)
        e = new
