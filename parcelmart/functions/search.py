"""Binary search in an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def borders_below(borders: Column, value: Column, most: int, or_equal: bool = False) -> Column:
    """How many of an array's rising values are less than ``value`` (or at most ``value``); the array holds up to ``most``.

    Halving steps, so as many comparisons as ``most`` has binary digits. ``borders`` and ``value`` must be plain columns.
    """
    steps = [1 << i for i in reversed(range(max(1, most).bit_length()))]

    def further(found: Column, step: Column) -> Column:
        border = F.get(borders, found + step - 1)
        passed = border <= value if or_equal else border < value
        return F.when(F.coalesce(passed, F.lit(False)), found + step).otherwise(found)

    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), further)
