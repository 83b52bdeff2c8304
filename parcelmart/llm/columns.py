"""Column helpers of the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(column: Column) -> Column:
    """A column that is computed once, where it stands.

    The optimizer may otherwise put its expression wherever it is used. Inside a lambda over an array, and in a
    filter that moves below the projection, it would then be computed anew for every element. A condition that is always
    true, but that Spark does not count as deterministic, keeps it in its place.
    """
    return F.when(F.spark_partition_id() >= 0, column)
