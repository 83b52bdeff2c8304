"""Cluster bootstrap with reproducible, partition-independent draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import rate

_COUNTS = ["late_poor", "late_n", "on_time_poor", "on_time_n"]


def cluster_bootstrap_gap(counts: DataFrame, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Late minus on-time poor-review rate, with a percentile interval from resampled weeks.

    ``counts`` has one row per week, so its size is bounded by the calendar. Draw (replicate, position) is a
    hash of both and the seed: the same on every cluster and after every retry. Replicate -1 takes each
    week once and yields the observed gap.
    """
    spark = counts.sparkSession
    weeks = counts.select(
        (F.row_number().over(Window.orderBy("week")) - 1).cast("bigint").alias("pick"), *_COUNTS
    )
    total = counts.agg(F.count(F.lit(1))).scalar()
    text = F.concat_ws("-", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("position").cast("string"))
    hashed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    draws = (
        spark.range(-1, iterations)
        .select(F.col("id").alias("replicate"), total.alias("weeks"))
        .filter("weeks > 0")
        .select("replicate", "weeks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("weeks") - 1)).alias("position"))
        .select(
            "replicate",
            F.when(F.col("replicate") < 0, F.col("position")).otherwise(hashed % F.col("weeks")).alias("pick"),
        )
    )
    sums = draws.join(F.broadcast(weeks), "pick").groupBy("replicate").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    gaps = sums.select(
        "replicate",
        (rate(F.col("late_poor"), F.col("late_n")) - rate(F.col("on_time_poor"), F.col("on_time_n"))).alias("gap"),
    )
    resampled = F.when(F.col("replicate") >= 0, F.col("gap"))
    # At most ``iterations`` gaps exist, so the built-in exact percentile is bounded here.
    return gaps.agg(
        F.max(F.when(F.col("replicate") < 0, F.col("gap"))).alias("difference"),
        F.percentile(resampled, F.lit(0.025)).alias("ci_low"),
        F.percentile(resampled, F.lit(0.975)).alias("ci_high"),
    ).withColumn("iterations", F.lit(iterations))
