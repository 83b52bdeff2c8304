"""Events per key: unpivoting date columns, and the time since the previous event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import elapsed_hours
from ..functions.search import borders_below
from ..sources.staging import stage

#: Of a long event table with hot keys: rows of the sample for each cell, most cells, and counters of the sketch of keys.
_SAMPLED, _CELLS, _TRACKED = 60, 1 << 16, 20_000

# Event name and the order column that dates it.
ORDER_STAGES = {
    "purchase": "order_purchase_timestamp",
    "approved": "order_approved_at",
    "carrier_handoff": "order_delivered_carrier_date",
    "delivered": "order_delivered_customer_date",
}


def _events(stages: Mapping[str, str], keep_null: Sequence[str]) -> Column:
    """Array of (standing, event_time, event_type). Standing 0 is dated, 1 undated but kept, 2 undated and to drop;
    sorting the array therefore orders by time, then name, with the kept undated events after the dated ones."""
    return F.array(
        *(
            F.struct(
                F.when(F.col(column).isNotNull(), 0).otherwise(1 if name in keep_null else 2).alias("standing"),
                F.col(column).alias("event_time"),
                F.lit(name).alias("event_type"),
            )
            for name, column in stages.items()
        )
    )


def unpivot_events(
    df: DataFrame,
    key: str = "order_id",
    stages: Mapping[str, str] = ORDER_STAGES,
    keep_null: Sequence[str] = ("purchase",),
) -> DataFrame:
    """One row per dated event, from a single scan; undated events stay only for the types in ``keep_null``."""
    events = df.select(key, F.inline(_events(stages, keep_null)))
    return events.filter("standing < 2").select(key, "event_type", "event_time")


def order_event_intervals(
    orders: DataFrame,
    key: str = "order_id",
    stages: Mapping[str, str] = ORDER_STAGES,
    keep_null: Sequence[str] = ("purchase",),
) -> DataFrame:
    """Events of a table with one row per key, with previous event and hours since it, without any shuffle."""
    ordered = orders.select(key, F.sort_array(_events(stages, keep_null)).alias("events"))
    exploded = ordered.select(key, "events", F.posexplode("events").alias("position", "event"))
    previous = F.get("events", F.col("position") - 1)
    return exploded.filter("event.standing < 2").select(
        key,
        F.col("event.event_type").alias("event_type"),
        F.col("event.event_time").alias("event_time"),
        previous["event_type"].alias("previous_event"),
        elapsed_hours(previous["event_time"], F.col("event.event_time")).alias("hours_since_previous"),
    )


def _borders(rows: DataFrame, order: Column, cell_rows: int) -> DataFrame | None:
    """(h, borders): for each hash of keys with more than ``cell_rows`` rows, what cuts its rows into cells of about so many.

    None if there is no such key.

    A sketch of ``_TRACKED`` counters finds the hashes, a sample of about ``_SAMPLED`` rows for each cell the borders. A table
    has at most ``_CELLS`` cells, and so borders; in larger tables cells grow instead.
    """
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", F.col("h"), F.lit(_TRACKED // 4), F.lit(_TRACKED)).alias("top")).first()
    size = max(cell_rows, found["n"] // _CELLS)
    hot = [(x["item"], -(-x["count"] // size)) for x in found["top"] or [] if x["count"] > size]
    if not hot:
        return None
    cells = F.broadcast(rows.sparkSession.createDataFrame(hot, "h long, cells long"))
    sample = rows.filter(F.col("salt") < F.lit(_SAMPLED / size)).select("h", order.alias("order")).join(cells, "h")
    group = Window.partitionBy("h")
    step = F.count(F.lit(1)).over(group) / F.col("cells")
    placed = sample.select("h", "order", F.row_number().over(group.orderBy("order")).alias("i"), step.alias("step"))
    chosen = placed.filter(F.floor(F.col("i") / F.col("step")) > F.floor((F.col("i") - 1) / F.col("step")))
    return stage(chosen.groupBy("h").agg(F.sort_array(F.collect_list("order")).alias("borders")), "event-borders")


def _celled(rows: DataFrame, order: Column, borders: DataFrame, how: str) -> DataFrame:
    """``rows`` with place, the order of rows of hot hashes, and cell: how many borders are below, 0 for other hashes."""
    b, x, low = F.col("borders"), F.col("place"), F.col("low")
    found = rows.join(F.broadcast(borders), "h", how).withColumn("place", F.when(b.isNotNull(), order))
    found = found.withColumn("low", F.when(b.isNotNull(), borders_below(b, x, _CELLS)).otherwise(0))
    equal = borders_below(b, x, _CELLS, or_equal=True) - low
    spread = F.when(b.isNotNull() & (F.get(b, low + 1) == x), F.floor(F.col("salt") * equal).cast("int"))
    return found.withColumn("cell", low + F.coalesce(spread, F.lit(0)))


def _ends(rows: DataFrame, order: Column, borders: DataFrame) -> DataFrame:
    """(h, cell, end): what stands before each cell of the hot hashes, before empty cells too."""
    last = _celled(rows, order, borders, "inner").groupBy("h", "cell").agg(F.max("place").alias("end"))
    every = borders.select("h", F.explode(F.sequence(F.lit(0), F.size("borders"))).alias("cell"))
    before = Window.partitionBy("h").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = every.join(last, ["h", "cell"], "left").select("h", "cell", F.last("end", ignorenulls=True).over(before).alias("end"))
    return ends.filter("end is not null")


def event_intervals(
    df: DataFrame,
    key: str = "order_id",
    time: str = "event_time",
    event_type: str = "event_type",
    ties: Sequence[str] = (),
    cell_rows: int = 1_000_000,
) -> DataFrame:
    """All columns of a long event table, with the previous event of the key and the hours since it.

    Events of a key are ordered by time, then type, then ``ties``, NULL times and types last. One shuffle by key brings its
    events together. A key with more than ``cell_rows`` events is cut into cells that rise in that order, so a hot key, day
    or moment is spread over many tasks: rows look back inside their cell, and the first of a cell to the last of
    the cell before. Rows that equal several borders are dealt out over the cells between them at random.
    """
    new = ("previous_event", "hours_since_previous")
    kept = [c for c in df.columns if c not in new]
    # Columns by place, whatever their names; the salt is drawn before anything is filtered, so all passes see the same.
    at = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*kept, key, time, event_type, *ties]))}
    rows = df.select(*(F.col(f"`{c}`").alias(name) for c, name in at.items()), F.xxhash64(F.col(f"`{key}`")).alias("h"), F.rand(0).alias("salt"))
    k, t, e, *rest = (F.col(at[c]) for c in (key, time, event_type, *ties))
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate((k, t.isNull(), t, e.isNull(), e, *rest))))
    borders = _borders(rows, place, cell_rows)
    celled = _celled(rows, place, borders, "left") if borders else rows.withColumn("cell", F.lit(0))
    inside = Window.partitionBy(k, "cell").orderBy(t.asc_nulls_last(), e.asc_nulls_last(), *rest)
    seen = F.struct(k.alias("k"), t.alias("t"), e.alias("e"))
    found = celled.select(*at.values(), "h", "cell", F.lag(seen).over(inside).alias("previous"))
    if borders:
        found = found.join(F.broadcast(_ends(rows, place, borders)), ["h", "cell"], "left")
        carried = F.when(F.col("end").isNotNull(), F.struct(F.col("end.o0").alias("k"), F.col("end.o2").alias("t"), F.col("end.o4").alias("e")))
        found = found.withColumn("previous", F.coalesce("previous", carried))
    same = F.col("previous").isNotNull() & F.col("previous.k").eqNullSafe(k)
    return found.select(
        *(F.col(at[c]).alias(c) for c in kept),
        F.when(same, F.col("previous.e")).alias(new[0]),
        F.when(same, elapsed_hours(F.col("previous.t"), t)).alias(new[1]),
    )
