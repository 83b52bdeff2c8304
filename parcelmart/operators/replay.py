"""Replaying rows to exercise scale; a replay adds volume, not observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed replay factors.
MIN_REPEATS, MAX_REPEATS = 1, 100


def replay(df: DataFrame, repeats: int = 20) -> DataFrame:
    """Every row ``repeats`` times, tagged with ``replay_id``; generated in place, without a join."""
    if not MIN_REPEATS <= repeats <= MAX_REPEATS:
        raise ValueError(f"repeats must lie between {MIN_REPEATS} and {MAX_REPEATS}")
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))
    return df.withColumn("replay_id", F.explode(copies))


def replay_aggregate(df: DataFrame, by: str = "customer_state") -> DataFrame:
    return (
        df.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("on_time").cast("int")).alias("on_time_n"))
        .orderBy(by)
    )


def replay_check(source: DataFrame, replayed: DataFrame, by: str = "customer_state", repeats: int = 20) -> DataFrame:
    """Groups compared, and groups whose replayed counts are not ``repeats`` times the source counts."""
    expected = replay_aggregate(source, by).select(
        by, (F.col("n") * repeats).alias("n_expected"), (F.col("on_time_n") * repeats).alias("on_time_expected")
    )
    actual = replay_aggregate(replayed, by).withColumnRenamed(by, "_replayed")
    same = F.col("n").eqNullSafe(F.col("n_expected")) & F.col("on_time_n").eqNullSafe(F.col("on_time_expected"))
    return (
        expected.join(actual, F.col(by).eqNullSafe(F.col("_replayed")), "full")
        .agg(F.count(F.lit(1)).alias("groups"), F.count_if(~same).alias("mismatches"))
        .withColumn("matches", F.col("mismatches") == 0)
    )
