"""Per-state views with an all-states total. Rows are aggregated once; totals come from the aggregated cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import rate
from .kpis import hidden_failures, on_time_reviewed
from .mart import eligible_orders
from .segments import reviewed_on_time_orders, with_interval

ALL_STATES = "All states"
# Inclusive lateness ranges in days.
LATENESS_BANDS = ((-1000, 0), (1, 3), (4, 7), (8, 1000))


def _with_total(cells: DataFrame, others: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add the total over states; cells without a state count in the total only."""
    sets = [["customer_state", *others], list(others)]
    rolled = cells.groupingSets(sets, "customer_state", *others).agg(
        *(F.sum(c).alias(c) for c in sums), F.grouping("customer_state").alias("_total")
    )
    return (
        rolled.filter((F.col("_total") == 1) | F.col("customer_state").isNotNull())
        .withColumn("state_view", F.when(F.col("_total") == 1, ALL_STATES).otherwise(F.col("customer_state")))
        .drop("customer_state", "_total")
    )


def view_cards(mart: DataFrame) -> DataFrame:
    sums = ["n", "on_time_n", "post_n", "reviewed", "hidden"]
    cells = (
        eligible_orders(mart)
        .groupBy("customer_state")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("on_time").alias("on_time_n"),
            F.count("poor_review").alias("post_n"),
            on_time_reviewed().alias("reviewed"),
            hidden_failures().alias("hidden"),
        )
    )
    cards = with_interval(_with_total(cells, [], sums), "hidden", "reviewed")
    return cards.select(
        "state_view",
        "n",
        rate(F.col("on_time_n"), F.col("n")).alias("on_time"),
        "reviewed",
        "hidden",
        "rate",
        "ci_low",
        "ci_high",
        rate(F.col("post_n"), F.col("n")).alias("coverage"),
    )


def view_monthly(mart: DataFrame) -> DataFrame:
    cells = (
        eligible_orders(mart)
        .groupBy("customer_state", "purchase_month")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("on_time").alias("on_time_n"),
            on_time_reviewed().alias("reviewed"),
            hidden_failures().alias("hidden"),
        )
    )
    return _with_total(cells, ["purchase_month"], ["n", "on_time_n", "reviewed", "hidden"]).select(
        "state_view",
        F.col("purchase_month").alias("month"),
        rate(F.col("on_time_n"), F.col("n")).alias("on_time"),
        rate(F.col("hidden"), F.col("reviewed")).alias("hidden"),
        "n",
    )


def view_top_categories(mart: DataFrame, k: int = 10, min_n: int = 30) -> DataFrame:
    """The ``k`` categories with most hidden failures in every state view."""
    cells = (
        reviewed_on_time_orders(mart)
        .filter(F.col("category").isNotNull())
        .groupBy("customer_state", "category")
        .agg(F.count(F.lit(1)).alias("reviewed_on_time"), F.count_if("poor_review").alias("hidden_failures"))
    )
    counts = _with_total(cells, ["category"], ["reviewed_on_time", "hidden_failures"])
    best = Window.partitionBy("state_view").orderBy(F.desc("hidden_failures"), "category")
    ranked = counts.filter(F.col("reviewed_on_time") >= min_n).withColumn("position", F.row_number().over(best))
    return with_interval(ranked.filter(F.col("position") <= k)).select(
        "state_view",
        "position",
        F.col("category").alias("segment"),
        "reviewed_on_time",
        "hidden_failures",
        "rate",
        "ci_low",
        "ci_high",
    )


def view_lateness_bands(mart: DataFrame, bands: Sequence[tuple[int, int]] = LATENESS_BANDS) -> DataFrame:
    names = [f"band_{i}" for i in range(len(bands))]
    cells = (
        eligible_orders(mart)
        .groupBy("customer_state")
        .agg(
            *(
                F.count_if(F.col("lateness_days").between(low, high)).alias(name)
                for name, (low, high) in zip(names, bands)
            )
        )
    )
    totals = _with_total(cells, [], names)
    rows = [
        F.struct(
            F.lit(low).cast("bigint").alias("low_days"),
            F.lit(high).cast("bigint").alias("high_days"),
            F.col(name).alias("orders"),
        )
        for name, (low, high) in zip(names, bands)
    ]
    return totals.select("state_view", F.inline(F.array(*rows)))
