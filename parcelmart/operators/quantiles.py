"""Exact, linearly interpolated percentiles that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(
    df: DataFrame,
    value: Column,
    percentiles: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    few: bool = False,
) -> DataFrame:
    """One row per group with one exact percentile per entry of ``percentiles`` (column name -> fraction).

    The built-in exact percentile holds every distinct value of a group in memory. Here one mergeable sketch brackets each
    wanted rank; one aggregation then keeps the values inside the brackets and only counts, with minimum and maximum, the
    stretches between them; ranks are read off running counts. The sketch misses a rank by at most 1 / ``accuracy`` of
    the group, and brackets reach twice as far, so every rank is inside its bracket and what is ordered in one task is
    4 / ``accuracy`` of a group for each percentile. Brackets are joined to their rows as Spark's size check decides. That
    check refuses to broadcast a table that leaves most shuffle partitions empty, and would sort a whole group in one
    task: ``few`` promises so few groups (months, columns of a table) that the brackets are always broadcast.
    """
    wanted = sorted(percentiles.items(), key=lambda item: item[1])
    slack = 2 / accuracy
    marks = [m for _, p in wanted for m in (max(0.0, p - slack), min(1.0, p + slack))]
    keys = [f"_key{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), value.cast("double").alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", marks, accuracy).alias("_marks"))
    if keys:
        right = sketch.select(*(F.col(k).alias(f"{k}_r") for k in keys), "_marks")
        right = F.broadcast(right) if few else right
        marked = rows.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys]).select(*keys, "_v", "_marks")
    else:
        marked = rows.withColumn("_marks", sketch.select("_marks").scalar())

    inside, stretch = F.lit(False), F.lit(0)
    for i in range(len(wanted)):
        low, high = F.get("_marks", F.lit(2 * i)), F.get("_marks", F.lit(2 * i + 1))
        inside = inside | F.col("_v").between(low, high)
        stretch = stretch + (F.col("_v") > high).cast("int")
    segments = (
        marked.withColumns({"_stretch": stretch, "_exact": F.when(inside, F.col("_v"))})
        .groupBy(*keys, "_stretch", "_exact")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    group = Window.partitionBy(*keys)
    running = group.orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)
    placed = segments.select(
        *keys, "_low", "_high", F.sum("_n").over(group).alias("_all"), F.sum("_n").over(running).alias("_end"), "_n"
    ).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank: Column) -> Column:
        # Inside a bracket low and high are one value; of a stretch only the ends can be asked for.
        known = F.when(rank == F.col("_start"), F.col("_low")).otherwise(F.col("_high"))
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), known))

    ends = []
    for i, (_, p) in enumerate(wanted):
        position = (F.col("_all") - 1) * F.lit(float(p))
        ends += [
            at(F.floor(position)).alias(f"_lo{i}"),
            at(F.ceil(position)).alias(f"_hi{i}"),
            F.max(position - F.floor(position)).alias(f"_part{i}"),
        ]
    found = placed.groupBy(*keys).agg(*ends)
    interpolated = {
        name: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}")
        for i, (name, _) in enumerate(wanted)
    }
    return found.select(
        *(F.col(k).alias(b) for k, b in zip(keys, by)), *(interpolated[name].alias(name) for name in percentiles)
    )
