from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelmart.schemas import SOURCE_SCHEMAS  # noqa: E402
from parcelmart.session import local_session  # noqa: E402
from parcelmart.sources import staging  # noqa: E402

ORDER_COLUMNS = [f.name for f in SOURCE_SCHEMAS["orders"]]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("parcelmart-tests", 8, {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    yield session
    staging.drop_staged(session)
    session.stop()


def at(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def make_tables(spark):
    """Source tables from plain rows; a table left out is empty."""

    def build(**rows):
        return {
            name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SOURCE_SCHEMAS.items()
        }

    return build


def order(order_id, status="delivered", delivered=None, estimate="2018-01-05", customer="customer", **changed):
    row = {
        "order_id": order_id,
        "customer_id": customer,
        "order_status": status,
        "order_purchase_timestamp": at("2018-01-01"),
        "order_approved_at": at("2018-01-01 01:00"),
        "order_delivered_carrier_date": at("2018-01-02"),
        "order_delivered_customer_date": at(delivered),
        "order_estimated_delivery_date": at(estimate),
    }
    row.update(changed)
    return tuple(row[c] for c in ORDER_COLUMNS)


def _shop_order(order_id, delivered, customer="north", status="delivered", promised="2023-03-20"):
    return order(
        order_id,
        status,
        delivered,
        promised,
        customer,
        order_purchase_timestamp=at("2023-03-10 18:20"),
        order_approved_at=at("2023-03-10 18:45"),
        order_delivered_carrier_date=at("2023-03-13 07:10"),
    )


#: A small shop: a basket of two sellers, a late parcel with a hasty review, an order never sent, an untranslated category, a delivery
#: before the purchase, a customer of unknown state, and two answers of one moment.
SHOP = {
    "orders": [
        _shop_order("basket", "2023-03-20 22:15"),
        _shop_order("late", "2023-03-21 00:05"),
        _shop_order("unsent", None, status="unavailable"),
        _shop_order("vase", "2023-03-16"),
        _shop_order("backwards", "2023-03-09"),
        _shop_order("stateless", "2023-03-17 12:00", customer="nowhere"),
    ],
    "customers": [("north", "PA"), ("nowhere", None)],
    "products": [("lamp", "luz", 820.0), ("vase", "vaso", 2400.0), ("bulb", "luz", 60.0)],
    "sellers": [("atelier", "PA"), ("depot", "CE")],
    "translation": [("luz", "lighting")],
    "items": [
        ("basket", 1, "lamp", "atelier", 64.5, 9.25),
        ("basket", 2, "bulb", "depot", 7.75, 3.5),
        ("basket", 3, "bulb", "depot", 7.75, 3.5),
        ("late", 1, "lamp", "depot", 59.9, 12.0),
        ("unsent", 1, "bulb", "depot", 8.0, 3.5),
        ("vase", 1, "vase", "depot", 130.0, 25.4),
        ("backwards", 1, "lamp", "depot", 61.0, 9.0),
        ("stateless", 1, "bulb", "atelier", 8.1, 4.0),
    ],
    "reviews": [
        ("q2", "basket", 2, at("2023-03-21"), at("2023-03-22 10:00")),
        ("q1", "basket", 4, at("2023-03-21"), at("2023-03-22 10:00")),
        ("q3", "basket", 5, at("2023-03-24"), at("2023-03-25 08:00")),
        ("q4", "late", 2, at("2023-03-17"), at("2023-03-18 09:30")),
        ("q5", "stateless", 1, at("2023-03-18"), at("2023-03-19 21:00")),
    ],
}


@pytest.fixture(scope="session")
def shop(make_tables):
    return make_tables(**SHOP)


OUTCOME_SCHEMA = (
    "order_id string, eligible boolean, on_time boolean, poor_review boolean, review_score int, customer_state string,"
    " category string, basket_band string, item_value_brl double, lateness_days int, delivery_days double,"
    " purchase_month date, order_purchase_timestamp timestamp_ntz"
)


@pytest.fixture(scope="session")
def outcomes(spark):
    """Mart-shaped rows for the grouped statistics; columns not given take a plain default."""
    names = [part.split()[0] for part in OUTCOME_SCHEMA.split(", ") if part.strip()]

    def build(rows):
        default = {
            "eligible": True,
            "on_time": True,
            "poor_review": None,
            "review_score": None,
            "customer_state": "SP",
            "category": "tools",
            "basket_band": "1 item",
            "item_value_brl": 100.0,
            "lateness_days": 0,
            "delivery_days": 1.0,
            "purchase_month": datetime(2018, 1, 1).date(),
            "order_purchase_timestamp": at("2018-01-01 10:00"),
        }
        full = [{**default, "order_id": str(i), **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], OUTCOME_SCHEMA)

    return build
