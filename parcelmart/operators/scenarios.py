"""What-if tables. Each is one aggregation pass; the ``evidence`` column marks values that were assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inference import rate
from .mart import eligible_orders


def _rows(totals: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return totals.select(F.inline(F.array(*rows)))


def eta_scenarios(mart: DataFrame, days: Sequence[int] = (0, 1, 2, 3, 5, 7)) -> DataFrame:
    """On-time rate if every recorded deadline were some days later; deliveries do not move."""
    late = F.col("lateness_days")
    totals = eligible_orders(mart).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if("on_time").alias("on_time"),
        *(F.count_if(late <= d).alias(f"within_{d}") for d in days),
        *(F.count_if((late > 0) & (late <= d)).alias(f"moved_{d}") for d in days),
    )
    return _rows(
        totals,
        [
            F.struct(
                F.lit(d).cast("bigint").alias("extension_days_assumed"),
                F.col("orders"),
                rate(F.col("on_time"), F.col("orders")).alias("recorded_on_time_rate"),
                rate(F.col(f"within_{d}"), F.col("orders")).alias("rescored_on_time_rate"),
                F.col(f"moved_{d}").alias("reclassified_orders"),
                F.lit("scenario_only").alias("evidence"),
            )
            for d in days
        ],
    )


def cost_scenarios(
    mart: DataFrame, margins: Sequence[float] = (0.1, 0.2, 0.3), recoveries: Sequence[int] = (10, 25, 50)
) -> DataFrame:
    """Assumed margin minus assumed recovery cost over on-time orders with an observed poor review."""
    grid = [(m, r) for m in margins for r in recoveries]
    contribution = [F.col("item_value_brl") * F.lit(m) - F.lit(r) for m, r in grid]
    totals = (
        eligible_orders(mart)
        .filter(F.col("on_time") & F.col("poor_review"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(F.count_if(c < 0).alias(f"negative_{i}") for i, c in enumerate(contribution)),
            *(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"sum_{i}") for i, c in enumerate(contribution)),
        )
    )
    return _rows(
        totals,
        [
            F.struct(
                F.lit(float(m)).alias("margin_assumed"),
                F.lit(r).cast("bigint").alias("recovery_brl_assumed"),
                F.col("n").alias("hidden_failure_orders"),
                (F.col("n") * r).alias("recovery_exposure_brl"),
                F.col(f"negative_{i}").alias("negative_proxy_orders"),
                F.col(f"sum_{i}").alias("proxy_contribution_brl"),
                F.lit("assumptions_only").alias("evidence"),
            )
            for i, (m, r) in enumerate(grid)
        ],
    )
