"""Monthly, state and headline indicators. Rates always come from summed counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import rate, wilson_high, wilson_low
from ..functions.order_rules import ReviewRule
from .mart import eligible_orders
from .quantiles import exact_percentiles


def on_time_reviewed() -> Column:
    return F.count_if(F.col("on_time") & F.col("poor_review").isNotNull())


def hidden_failures() -> Column:
    """Orders delivered on time and still reviewed poorly."""
    return F.count_if(F.col("on_time") & F.col("poor_review"))


def _flag_mean(flag: str, where: Column | None = None) -> Column:
    value = F.col(flag).cast("int")
    return F.avg(value if where is None else F.when(where, value))


def monthly_kpis(mart: DataFrame) -> DataFrame:
    rows = eligible_orders(mart)
    counts = rows.groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if("on_time").alias("on_time_orders"),
        F.count_if(~F.col("on_time")).alias("late_orders"),
        F.count("poor_review").alias("reviewed_orders"),
        on_time_reviewed().alias("reviewed_on_time"),
        hidden_failures().alias("hidden_failure_orders"),
        _flag_mean("on_time").alias("on_time_rate"),
        _flag_mean("poor_review", F.col("on_time")).alias("hidden_failure_rate"),
    )
    p90 = exact_percentiles(rows, F.col("delivery_days"), {"p90_delivery_days": 0.9}, ["purchase_month"], few=True)
    return counts.join(p90, "purchase_month", "left")


def state_priorities(mart: DataFrame, min_n: int = 100) -> DataFrame:
    return (
        eligible_orders(mart)
        .groupBy("customer_state")
        .agg(
            F.count(F.lit(1)).alias("eligible_orders"),
            on_time_reviewed().alias("reviewed_on_time"),
            hidden_failures().alias("hidden_failures"),
            _flag_mean("poor_review", F.col("on_time")).alias("hidden_failure_rate"),
        )
        .filter(F.col("reviewed_on_time") >= min_n)
        .orderBy(F.desc("hidden_failures"), "customer_state")
    )


def monthly_rank(mart: DataFrame, by: str = "customer_state", min_n: int = 100) -> DataFrame:
    """Reliability rank inside each month, worst on-time rate first; the window sees one row per cell."""
    cells = (
        eligible_orders(mart)
        .groupBy("purchase_month", by)
        .agg(F.count(F.lit(1)).alias("n"), _flag_mean("on_time").alias("on_time_rate"))
        .filter(F.col("n") >= min_n)
    )
    in_month = Window.partitionBy("purchase_month").orderBy("on_time_rate")
    return cells.withColumn("reliability_rank", F.dense_rank().over(in_month)).orderBy(
        "purchase_month", "reliability_rank", by
    )


def headline(mart: DataFrame) -> DataFrame:
    """One row with the population counts, the hidden-failure rate and its 95 % interval."""
    rows = eligible_orders(mart)
    p90 = exact_percentiles(rows, F.col("delivery_days"), {"p90": 0.9})
    counts = rows.agg(
        F.count(F.lit(1)).alias("eligible_orders"),
        F.min("order_purchase_timestamp").alias("purchase_min"),
        F.max("order_purchase_timestamp").alias("purchase_max"),
        F.count_if("on_time").alias("on_time_orders"),
        F.count("poor_review").alias("reviewed_orders"),
        on_time_reviewed().alias("reviewed_on_time"),
        hidden_failures().alias("hidden_failure_orders"),
        _flag_mean("poor_review", ~F.col("on_time")).alias("poor_review_rate_late"),
    )
    k, n = F.col("hidden_failure_orders"), F.col("reviewed_on_time")
    return counts.select(
        "eligible_orders",
        "purchase_min",
        "purchase_max",
        "on_time_orders",
        rate(F.col("on_time_orders"), F.col("eligible_orders")).alias("on_time_rate"),
        "reviewed_orders",
        rate(F.col("reviewed_orders"), F.col("eligible_orders")).alias("review_coverage"),
        "reviewed_on_time",
        "hidden_failure_orders",
        rate(k, n).alias("hidden_failure_rate"),
        wilson_low(k, n).alias("hidden_failure_ci_low"),
        wilson_high(k, n).alias("hidden_failure_ci_high"),
        "poor_review_rate_late",
        p90.scalar().alias("p90_delivery_days"),
    )


def hidden_failure_headline(mart: DataFrame) -> DataFrame:
    totals = eligible_orders(mart).agg(
        on_time_reviewed().alias("reviewed_on_time"), hidden_failures().alias("hidden_failures")
    )
    return totals.withColumn("rate", rate(F.col("hidden_failures"), F.col("reviewed_on_time")))


def review_sensitivity(mart: DataFrame, rule: ReviewRule = ReviewRule()) -> DataFrame:
    """Does review timing distort the comparison of on-time and late orders?"""
    by_outcome = (
        eligible_orders(mart)
        .groupBy("on_time")
        .agg(
            F.count(F.lit(1)).alias("eligible_orders"),
            F.count("poor_review").alias("post_n"),
            _flag_mean("poor_review").alias("post_delivery_poor_rate"),
            F.count("review_score").alias("any_timing_review_n"),
            F.avg((F.col("review_score") <= rule.poor_max).cast("int")).alias("any_timing_poor_rate"),
        )
    )
    return by_outcome.orderBy(F.desc("on_time")).select(
        F.when(F.col("on_time"), "on_time").otherwise("late").alias("group"),
        "eligible_orders",
        rate(F.col("post_n"), F.col("eligible_orders")).alias("post_delivery_review_coverage"),
        "post_delivery_poor_rate",
        "any_timing_review_n",
        "any_timing_poor_rate",
    )


def top_segments(segments: DataFrame, k: int = 6, order: Sequence[str] = ("hidden_failures",)) -> DataFrame:
    return segments.orderBy(*(F.desc(c) for c in order), "segment").limit(k)
