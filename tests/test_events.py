import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, order
from parcelmart.operators.events import event_intervals, order_event_intervals, unpivot_events


def _naive(rows):
    """Previous event per key in (time, type) order, NULL last."""
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted(
            (r for r in rows if r[0] == key),
            key=lambda r: (r[1] is None, r[1] or datetime.min, r[2] is None, r[2] or ""),
        )
        for i, (_, t, e) in enumerate(mine):
            before = mine[i - 1] if i else (None, None, None)
            hours = (t - before[1]).total_seconds() / 3600 if i and t and before[1] else None
            out.append((key, e, t, before[2], None if hours is None else round(hours, 6)))
    return sorted(out, key=repr)


def _result(df):
    return sorted(((a, b, c, d, None if e is None else round(e, 6)) for a, b, c, d, e in df.collect()), key=repr)


def test_unpivot_keeps_only_undated_purchases(make_tables):
    tables = make_tables(
        orders=[order("x", delivered="2018-01-03"), order("y", order_purchase_timestamp=None, order_approved_at=None)]
    )
    got = sorted((r.order_id, r.event_type) for r in unpivot_events(tables["orders"]).collect())
    assert got == [
        ("x", "approved"), ("x", "carrier_handoff"), ("x", "delivered"), ("x", "purchase"),
        ("y", "carrier_handoff"), ("y", "purchase"),
    ]


def test_ties_sort_by_name_and_undated_events_come_last(make_tables):
    tables = make_tables(
        orders=[
            order("tie", order_approved_at=at("2018-01-01"), order_delivered_carrier_date=None),
            order("undated", order_purchase_timestamp=None),
        ]
    )
    rows = [(r.order_id, r.event_type, r.previous_event, r.hours_since_previous) for r in order_event_intervals(tables["orders"]).collect()]
    assert sorted(rows, key=repr) == sorted(
        [
            ("tie", "approved", None, None),
            ("tie", "purchase", "approved", 0.0),
            ("undated", "approved", None, None),
            ("undated", "carrier_handoff", "approved", 23.0),
            ("undated", "purchase", "carrier_handoff", None),
        ],
        key=repr,
    )
    long = event_intervals(unpivot_events(tables["orders"]))
    assert _of(long, "order_id", "event_time", "event_type") == _result(order_event_intervals(tables["orders"]))


def _of(df, key, time, event_type):
    return _result(df.select(key, event_type, time, "previous_event", "hours_since_previous"))


def _random_events(rng, n, keys, hours):
    start = datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        key = None if rng.random() < 0.1 else 7 if rng.random() < 0.34 else rng.randrange(keys)
        time = None if rng.random() < 0.05 else start + timedelta(hours=rng.choice(hours))
        rows.append((key, time, None if rng.random() < 0.05 else rng.choice("abc")))
    return rows


@pytest.fixture
def fine_ranges(spark):
    """Small tables would otherwise end in one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keys, hours", [(60, [0, 1, 5, 30, 31, 200, 1000]), (8, [0, 1, 2]), (8, [0])])
def test_keys_and_moments_of_any_size(spark, fine_ranges, keys, hours):
    rows = _random_events(random.Random(3), 1500, keys, hours)
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, e string").repartition(3)
    assert _of(event_intervals(df, "k", "t", "e"), "k", "t", "e") == _naive(rows)
    assert _of(event_intervals(df, "k", "t", "e", cell_rows=20), "k", "t", "e") == _naive(rows)


def test_hot_keys_are_cut_into_cells_of_like_size(spark, fine_ranges):
    start = datetime(2024, 1, 1)
    rows = [(1 if i % 3 else i, start + timedelta(minutes=i * i % 7919), "ab"[i % 2], i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, e string, id int").repartition(4)
    got = event_intervals(df, "k", "t", "e", ["id"], cell_rows=200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # One shuffle of rows; the others carry one row per cell.
    assert plan.count("Exchange hashpartitioning(h#") - plan.count("_before") >= 1 and "rangepartitioning" not in plan
    tied = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3]))
    want = {b[3]: (a[2], (b[1] - a[1]).total_seconds() / 3600) if a[0] == b[0] else (None, None) for a, b in zip(tied, tied[1:])}
    want[tied[0][3]] = (None, None)
    found = {r.id: (r.previous_event, r.hours_since_previous) for r in got.collect()}
    assert all(found[i][0] == w[0] and (w[1] is None or abs(found[i][1] - w[1]) < 1e-9) for i, w in want.items())
    sizes = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 4000 * 0.6


def test_one_key_one_moment_is_spread_over_ranges(spark, fine_ranges):
    """Copies of one event differ by no column and still land in several tasks."""
    rows = [(1, datetime(2024, 1, 1), "a")] * 20_000
    df = event_intervals(spark.createDataFrame(rows, "k int, t timestamp_ntz, e string").repartition(4), "k", "t", "e", cell_rows=1000)
    assert df.groupBy("previous_event", "hours_since_previous").count().orderBy("count").collect() == [(None, None, 1), ("a", 0.0, 19_999)]
    assert df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 12_000


def test_other_columns_stay_and_ties_order_equal_events(spark, fine_ranges):
    moment = datetime(2024, 1, 1)
    rows = [(1, moment, "a", 30, {"x": "1"}), (1, moment, "a", 10, None), (1, moment, "a", 20, {"y": "2"}), (2, None, None, 5, None)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, e string, id int, extra map<string,string>")
    got = event_intervals(df, "k", "t", "e", ["id"])
    assert got.columns == [*df.columns, "previous_event", "hours_since_previous"]
    assert sorted((r.id, r.extra, r.previous_event, r.hours_since_previous) for r in got.collect()) == [
        (5, None, None, None), (10, None, None, None), (20, {"y": "2"}, "a", 0.0), (30, {"x": "1"}, "a", 0.0),
    ]
    assert event_intervals(df.limit(0), "k", "t", "e").collect() == []
