import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import at, order
from parcelmart.operators import mart as M
from parcelmart.plans import oracle


@pytest.fixture(scope="module")
def rows(shop):
    return {r.order_id: r for r in M.build_mart(shop).collect()}


def test_grain_and_value(rows):
    assert sorted(rows) == ["backwards", "basket", "late", "stateless", "unsent", "vase"]
    assert rows["basket"].item_value_brl == 80 and (rows["basket"].item_count, rows["basket"].seller_count) == (3, 2)
    assert round(sum(r.item_value_brl for r in rows.values()), 6) == 347


def test_the_promised_day_counts_to_its_end(rows):
    assert rows["basket"].on_time is True and rows["basket"].lateness_days == 0
    assert rows["late"].on_time is False and rows["late"].lateness_days == 1


def test_review_choice_and_timing(rows):
    # Of answers of one moment the one of smaller id.
    assert rows["basket"].post_delivery_score == 4 and rows["basket"].poor_review is False
    assert rows["late"].review_score == 2 and rows["late"].poor_review is None
    assert rows["vase"].poor_review is None
    assert rows["stateless"].poor_review is True


def test_unsent_and_impossible_orders_are_not_eligible(rows):
    assert rows["unsent"].eligible is False and rows["backwards"].eligible is False
    assert rows["unsent"].on_time is None


def test_bands_stages_and_states(rows):
    assert {o: r.basket_band for o, r in rows.items() if r.basket_band != "1 item"} == {"basket": "2+ items"}
    assert sorted(o for o, r in rows.items() if not r.valid_stages) == ["backwards", "unsent"]
    assert {o: r.interstate for o, r in rows.items()} == {"basket": 1, "late": 1, "unsent": 1, "vase": 1, "backwards": 1, "stateless": 0}
    assert (rows["vase"].category, rows["basket"].category, rows["stateless"].customer_state) == ("unknown", "lighting", None)
    assert len(rows["basket"]) == 32


def test_order_without_items_is_unknown_not_false(make_tables):
    tables = make_tables(orders=[order("x", delivered="2018-01-03"), order("y", status="canceled")])
    got = {r.order_id: r for r in M.build_mart(tables).collect()}
    assert got["x"].eligible is None and got["x"].interstate is None and got["x"].basket_band == "unknown"
    assert got["y"].eligible is False


def test_categories_and_states(make_tables):
    tables = make_tables(
        orders=[order(o, delivered="2018-01-03", customer="k" if o != "n" else "nobody") for o in "mstuwn"],
        customers=[("k", "SP")],
        products=[("p1", "c1", 1.0), ("p2", "c2", 3.0), ("p0", None, None), ("px", "untranslated", 2.0)],
        translation=[("c1", "one"), ("c2", "two")],
        sellers=[("s1", "SP"), ("s2", "RJ"), ("s0", None)],
        items=[
            ("m", 1, "p1", "s1", 1.0, 0.0),
            ("m", 2, "p2", "s1", 1.0, 0.0),
            ("s", 1, "p1", "s1", 1.0, 0.0),
            ("s", 2, "p0", "s0", 1.0, 0.0),
            ("t", 1, "p1", "s1", 1.0, 0.0),
            ("t", 2, "p2", "s2", 1.0, 0.0),
            ("u", 1, "px", "s2", 1.0, 0.0),
            ("w", 1, "absent", "absent", 1.0, 0.0),
            ("n", 1, "p1", "s2", 1.0, 0.0),
            ("orphan", 1, "p1", "s1", 1.0, 0.0),
        ],
    )
    got = {r.order_id: r for r in M.build_mart(tables).collect()}
    assert set(got) == set("mstuwn")
    assert {o: got[o].category for o in "mstuw"} == {
        "m": "mixed_categories",
        "s": "one",
        "t": "mixed_categories",
        "u": "unknown",
        "w": "unknown",
    }
    assert {o: got[o].interstate for o in "mstuwn"} == {"m": 0, "s": 0, "t": 1, "u": 1, "w": 0, "n": 0}
    assert got["s"].category_count == 1 and got["w"].category_count == 0 and got["u"].category_count == 1
    assert got["m"].mean_weight_g == 2.0 and got["w"].mean_weight_g is None


def test_review_ties(make_tables):
    answered = at("2018-01-07")
    tables = make_tables(
        reviews=[
            ("z", "o1", 5, None, answered),
            ("y", "o1", 4, None, answered),
            (None, "o2", 1, None, answered),
            ("q", "o2", 5, None, answered),
            ("same", "o3", 3, at("2018-01-02"), answered),
            ("same", "o3", 2, at("2018-01-03"), answered),
            ("bad", "o4", 9, None, at("2018-01-01")),
            ("late", "o4", 3, None, answered),
            ("open", "o5", 3, None, None),
        ]
    )
    got = {r.order_id: r.review_score for r in M.first_review(tables["reviews"]).collect()}
    assert got == {"o1": 4, "o2": 5, "o3": 2, "o4": 3}


def test_orphan_items_are_left_out(shop):
    parts = [shop[n] for n in ("items", "products", "translation", "sellers")]
    some = shop["orders"].filter("order_id <> 'vase'")
    assert "vase" in {r.order_id for r in M.item_summary(*parts).collect()}
    assert "vase" not in {r.order_id for r in M.item_summary(*parts, some).collect()}


def test_no_single_partition_in_the_mart(shop):
    plan = M.build_mart(shop)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_items_are_shuffled_once_by_order(shop):
    """Expand would shuffle every item once for each distinct count; orders are met by the summary, not by the items."""
    plan = M.build_mart(shop)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "LeftSemi" not in plan


def test_sellers_and_categories_are_counted_once(make_tables):
    items = [("o", n, f"p{n % 3}", s, 1.0, 0.5) for n, s in enumerate(["s1", "s1", None, "s2", "s1", "s2", None])]
    tables = make_tables(
        orders=[order("o", delivered="2018-01-03"), order("n", delivered="2018-01-03")],
        products=[("p0", "c0", 1.0), ("p1", "c1", 3.0), ("p2", None, None)],
        items=[*items, ("n", 1, None, None, 2.0, 0.0), ("n", 2, None, None, None, 0.0), (None, 1, "p0", "s1", 1.0, 0.0)],
    )
    got = {r.order_id: (r.item_count, r.seller_count, r.category_count, r.item_value_brl) for r in M.build_mart(tables).collect()}
    assert got == {"o": (7, 2, 2, 7.0), "n": (2, 0, 0, 2.0)}


def test_hot_order_against_sql(spark):
    """One order holds a third of all items and reviews; the result must equal plain SQL."""
    rng = random.Random(5)
    hot = lambda: 0 if rng.random() < 0.34 else rng.randrange(1, 400)
    items = [
        (hot(), n, rng.randrange(50), rng.randrange(60), rng.randrange(1, 9999) / 100, rng.randrange(99) / 100)
        for n in range(6000)
    ]
    reviews = [
        (f"r{n}", hot(), rng.randrange(0, 7), at(f"2018-01-{rng.randrange(1, 9):02d}"), at(f"2018-02-{rng.randrange(1, 4):02d}"))
        for n in range(3000)
    ]
    frames = {
        "raw_orders": pd.DataFrame(
            [order(i, delivered="2018-01-06" if i % 3 else None, customer=i % 80) for i in range(450)],
            columns=[
                "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
            ],
        ),
        "raw_items": pd.DataFrame(items, columns=["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"]),
        "raw_reviews": pd.DataFrame(reviews, columns=["review_id", "order_id", "review_score", "review_creation_date", "review_answer_timestamp"]),
        "raw_customers": pd.DataFrame([(i, f"S{i % 5}" if i % 7 else None) for i in range(80)], columns=["customer_id", "customer_state"]),
        "raw_products": pd.DataFrame([(i, f"c{i % 6}" if i % 5 else None, 10.0 * i) for i in range(45)], columns=["product_id", "product_category_name", "product_weight_g"]),
        "raw_sellers": pd.DataFrame([(i, f"S{i % 5}" if i % 11 else None) for i in range(55)], columns=["seller_id", "seller_state"]),
        "raw_translation": pd.DataFrame([(f"c{i}", f"english {i}") for i in range(5)], columns=["product_category_name", "product_category_name_english"]),
    }
    tables = {}
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
        sdf = spark.createDataFrame(frame)
        for field in sdf.schema:
            if field.dataType.typeName() == "timestamp":
                sdf = sdf.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
        tables[name[4:]] = sdf
    columns = [
        "order_id", "customer_state", "item_count", "seller_count", "category_count", "category", "interstate",
        "review_score", "eligible", "on_time", "poor_review", "basket_band", "valid_stages",
    ]
    expected = con.execute(f"WITH {oracle.MART} SELECT {', '.join(columns)}, round(item_value_brl, 4) FROM mart ORDER BY 1").fetchall()
    got = M.build_mart(tables).select(*columns, F.round("item_value_brl", 4)).orderBy("order_id").collect()
    assert [tuple(r) for r in got] == expected
