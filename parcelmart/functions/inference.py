"""Interval, planning and cost formulas as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.959963984540054
FALSE_POSITIVE_COST = 3.0
FALSE_NEGATIVE_COST = 25.0


def rate(k: Column, n: Column) -> Column:
    """k / n, NULL when n is 0 (ANSI division would raise)."""
    return F.try_divide(k.cast("double"), n.cast("double"))


def _wilson_parts(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    size = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / size
    spread = 1 + z * z / size
    centre = (p + z * z / (2 * size)) / spread
    radius = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / spread
    return centre, radius


def wilson_low(k: Column, n: Column, z: float = Z_95) -> Column:
    centre, radius = _wilson_parts(k, n, z)
    return F.when(n == 0, None).when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - radius))


def wilson_high(k: Column, n: Column, z: float = Z_95) -> Column:
    centre, radius = _wilson_parts(k, n, z)
    return F.when(n == 0, None).when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + radius))


def sample_size(p1: Column, p2: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Observations per arm to tell two proportions apart, two-sided; NULL when they are equal."""
    z_alpha = NormalDist().inv_cdf(1 - alpha / 2)
    z_power = NormalDist().inv_cdf(power)
    pooled = (p1 + p2) / 2
    under_null = z_alpha * F.sqrt(2 * pooled * (1 - pooled))
    under_alternative = z_power * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    effect = F.nullif(F.abs(p2 - p1), F.lit(0.0))
    ratio = (under_null + under_alternative) / effect
    return F.ceil(ratio * ratio).cast("bigint")


def error_cost(
    label: Column,
    predicted: Column,
    false_positive: float = FALSE_POSITIVE_COST,
    false_negative: float = FALSE_NEGATIVE_COST,
) -> Column:
    """Assumed cost of one decision; sum it for the cost of a decision rule."""
    positive = label.cast("int") == 1
    alerted = predicted.cast("int") == 1
    return (
        F.when(alerted & ~positive, F.lit(false_positive))
        .when(~alerted & positive, F.lit(false_negative))
        .otherwise(0.0)
    )
