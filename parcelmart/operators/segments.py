"""Statistics on grouped orders: segment intervals, weekly clusters, direct standardization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inference import rate, sample_size, wilson_high, wilson_low
from .mart import eligible_orders


def reviewed_on_time_orders(mart: DataFrame) -> DataFrame:
    return eligible_orders(mart).filter(F.col("on_time") & F.col("poor_review").isNotNull())


def with_interval(counts: DataFrame, k: str = "hidden_failures", n: str = "reviewed_on_time") -> DataFrame:
    successes, size = F.col(k), F.col(n)
    return counts.withColumns(
        {
            "rate": rate(successes, size),
            "ci_low": wilson_low(successes, size),
            "ci_high": wilson_high(successes, size),
        }
    )


def segment_table(mart: DataFrame, column: str, min_n: int = 100) -> DataFrame:
    """Hidden-failure rate with interval for every segment that has at least ``min_n`` reviewed orders."""
    counts = (
        reviewed_on_time_orders(mart)
        .filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("segment"))
        .agg(F.count(F.lit(1)).alias("reviewed_on_time"), F.count_if("poor_review").alias("hidden_failures"))
        .filter(F.col("reviewed_on_time") >= min_n)
    )
    return with_interval(counts).orderBy(F.desc("hidden_failures"), "segment")


def experiment_sizes(
    segments: DataFrame, relative_change: float = -0.2, alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Orders per arm needed in each segment to see its rate change by ``relative_change``."""
    target = F.col("rate") * F.lit(1 + relative_change)
    return segments.select(
        "segment", "rate", sample_size(F.col("rate"), target, alpha, power).alias("sample_per_arm")
    )


def weekly_cluster_counts(mart: DataFrame) -> DataFrame:
    """Poor reviews and reviews per purchase week (Monday to Sunday), late and on time side by side."""
    poor, punctual = F.col("poor_review"), F.col("on_time")
    return (
        eligible_orders(mart)
        .filter(poor.isNotNull() & F.col("order_purchase_timestamp").isNotNull())
        .groupBy(F.trunc(F.to_date("order_purchase_timestamp"), "week").alias("week"))
        .agg(
            F.count_if(~punctual & poor).alias("late_poor"),
            F.count_if(~punctual).alias("late_n"),
            F.count_if(punctual & poor).alias("on_time_poor"),
            F.count_if(punctual).alias("on_time_n"),
        )
    )


def direct_standardization(
    mart: DataFrame,
    stratum: str = "customer_state",
    group: str = "basket_band",
    levels: Sequence[str] = ("1 item", "2+ items"),
    min_n: int = 30,
) -> DataFrame:
    """Compare two groups with common stratum weights; NULL estimates when no stratum is large enough in both.

    One pass counts per stratum; the crude rates are sums of the same counts.
    """
    first, second = levels
    in_first, in_second = F.col(group) == first, F.col(group) == second
    poor = F.col("poor_review")
    strata = (
        reviewed_on_time_orders(mart)
        .groupBy(stratum)
        .agg(
            F.count_if(in_first).alias("n1"),
            F.count_if(in_first & poor).alias("k1"),
            F.count_if(in_second).alias("n2"),
            F.count_if(in_second & poor).alias("k2"),
        )
        .withColumn("common", F.col(stratum).isNotNull() & (F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    )
    weight = F.when(F.col("common"), F.col("n1") + F.col("n2"))
    totals = strata.agg(
        rate(F.sum("k1"), F.sum("n1")).alias("crude_single"),
        rate(F.sum("k2"), F.sum("n2")).alias("crude_multi"),
        F.try_divide(F.sum(weight * rate(F.col("k1"), F.col("n1"))), F.sum(weight)).alias("standardized_single"),
        F.try_divide(F.sum(weight * rate(F.col("k2"), F.col("n2"))), F.sum(weight)).alias("standardized_multi"),
        F.count_if("common").alias("common_states"),
    )
    crude_gap = F.col("crude_multi") - F.col("crude_single")
    standard_gap = F.col("standardized_multi") - F.col("standardized_single")
    return totals.withColumn("sign_reversal", crude_gap * standard_gap < 0)
