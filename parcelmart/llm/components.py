"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = edges.join(least, "a").filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is the smallest node of it.

    Each step reduces per node before it joins, so a node with very many edges is no single task's work: minima are
    combined before the shuffle and the join may be split. Steps are written to the checkpoint folder; the number of
    steps grows with the logarithm of the longest path. Edges with a NULL end and loops are left out.
    """
    current = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("_two"))
        .filter("_two")
        .select("a", "b")
        .distinct(),
        "components",
    )
    seen, some = None, current.limit(1).count()
    while some:
        watch = Observation()
        step = _small_star(_large_star(current))
        current = stage(
            step.observe(watch, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "components"
        )
        now = (watch.get["n"], watch.get["x"])
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )
