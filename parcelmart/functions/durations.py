"""Elapsed time between zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed_micros(start: Column, end: Column) -> Column:
    """Exact microseconds from ``start`` to ``end``. Subtracting zone-free timestamps ignores the session zone."""
    gap = end - start
    part = lambda unit: F.extract(F.lit(unit), gap)
    whole_minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return whole_minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return elapsed_micros(start, end) / F.lit(1_000_000.0)


def elapsed_days(start: Column, end: Column) -> Column:
    return elapsed_seconds(start, end) / F.lit(86_400.0)


def elapsed_hours(start: Column, end: Column) -> Column:
    return elapsed_seconds(start, end) / F.lit(3_600.0)
