"""Column types of the seven source tables and the column list of the public export."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


SOURCE_SCHEMAS: dict[str, StructType] = {
    "orders": _table(
        order_id=StringType,
        customer_id=StringType,
        order_status=StringType,
        order_purchase_timestamp=TimestampNTZType,
        order_approved_at=TimestampNTZType,
        order_delivered_carrier_date=TimestampNTZType,
        order_delivered_customer_date=TimestampNTZType,
        order_estimated_delivery_date=TimestampNTZType,
    ),
    "items": _table(
        order_id=StringType,
        order_item_id=IntegerType,
        product_id=StringType,
        seller_id=StringType,
        price=DoubleType,
        freight_value=DoubleType,
    ),
    "reviews": _table(
        review_id=StringType,
        order_id=StringType,
        review_score=IntegerType,
        review_creation_date=TimestampNTZType,
        review_answer_timestamp=TimestampNTZType,
    ),
    "customers": _table(customer_id=StringType, customer_state=StringType),
    "products": _table(product_id=StringType, product_category_name=StringType, product_weight_g=DoubleType),
    "sellers": _table(seller_id=StringType, seller_state=StringType),
    "translation": _table(product_category_name=StringType, product_category_name_english=StringType),
}

# The key of each table that must be unique and non-null.
DIMENSION_KEYS = {
    "orders": "order_id",
    "customers": "customer_id",
    "products": "product_id",
    "sellers": "seller_id",
    "translation": "product_category_name",
}

# Columns that may leave the warehouse (no customer id, no review text, no raw dates).
EXPORT_COLUMNS = [
    "order_id",
    "purchase_month",
    "customer_state",
    "category",
    "basket_band",
    "item_count",
    "item_value_brl",
    "freight_charged_brl",
    "promise_days",
    "lateness_days",
    "delivery_days",
    "handling_days",
    "transit_days",
    "valid_stages",
    "on_time",
    "post_delivery_score",
    "poor_review",
]
