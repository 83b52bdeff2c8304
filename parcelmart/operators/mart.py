"""The order mart: one row per order, items and reviews reduced to the order before any join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import order_rules as rules
from ..functions.durations import elapsed_days
from ..functions.order_rules import ReviewRule
from ..schemas import EXPORT_COLUMNS

def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group. Spark keeps one candidate per group and task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_position", F.row_number().over(window)).filter("_position = 1").drop("_position")


def item_summary(
    items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    sellers: DataFrame,
    orders: DataFrame | None = None,
) -> DataFrame:
    """One row per order with items; given ``orders``, items of other orders are left out.

    Items are first added up by (order, seller, category), so a hot order is combined before it is dealt to one task and
    what is left of it is one row per seller and category. These rows are shuffled once, by order: distinct sellers and
    categories are sets of the order (``count_distinct`` of two columns would shuffle every row three times). Labels travel
    as text with the rows, and their least and greatest value tell whether an order has one or several; dimensions are
    joined once and left to Spark's size check.
    """
    labelled = products.join(translation, "product_category_name", "left").select(
        "product_id", "product_category_name", "product_category_name_english", "product_weight_g"
    )
    parts = (
        items.select("order_id", "product_id", "seller_id", "price", "freight_value")
        .join(labelled, "product_id", "left")
        .join(sellers.select("seller_id", "seller_state"), "seller_id", "left")
        .groupBy("order_id", "seller_id", "seller_state", "product_category_name", "product_category_name_english")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("price").alias("price"),
            F.sum("freight_value").alias("freight"),
            F.sum("product_weight_g").alias("weight"),
            F.count("product_weight_g").alias("weighed"),
        )
    )
    grouped = (
        parts.repartition("order_id")
        .groupBy("order_id")
        .agg(
            F.sum("n").alias("item_count"),
            F.size(F.collect_set("seller_id")).cast("bigint").alias("seller_count"),
            F.sum("price").alias("item_value_brl"),
            F.sum("freight").alias("freight_charged_brl"),
            F.size(F.collect_set("product_category_name")).cast("bigint").alias("category_count"),
            F.try_divide(F.sum("weight"), F.sum("weighed")).alias("mean_weight_g"),
            F.max("product_category_name_english").alias("_label"),
            F.min("seller_state").alias("one_seller_state"),
            F.max("seller_state").alias("_other_state"),
        )
    )
    if orders is not None:
        grouped = grouped.join(orders.select("order_id"), "order_id", "left_semi")
    category = F.when(F.col("category_count") > 1, "mixed_categories").otherwise(F.coalesce("_label", F.lit("unknown")))
    return grouped.select(
        "order_id",
        "item_count",
        "seller_count",
        "item_value_brl",
        "freight_charged_brl",
        "category_count",
        category.alias("category"),
        "mean_weight_g",
        "one_seller_state",
        (F.col("one_seller_state") != F.col("_other_state")).alias("several_seller_states"),
    )


def first_review(reviews: DataFrame, rule: ReviewRule = ReviewRule()) -> DataFrame:
    """Earliest answered review of each order; missing ids and dates sort last."""
    answered = reviews.filter(
        F.col("review_score").between(rule.lowest, rule.highest) & F.col("review_answer_timestamp").isNotNull()
    )
    order = [
        F.col(c).asc_nulls_last()
        for c in ("review_answer_timestamp", "review_id", "review_score", "review_creation_date")
    ]
    return first_per_group(answered, ["order_id"], order).select(
        "order_id", "review_score", "review_answer_timestamp", "review_creation_date"
    )


def join_order_context(orders: DataFrame, customers: DataFrame, summary: DataFrame, review: DataFrame) -> DataFrame:
    """Orders with customer state, item summary and review; all three joins keep every order once."""
    joined = (
        orders.join(customers.select("customer_id", "customer_state"), "customer_id", "left")
        .join(summary, "order_id", "left")
        .join(review, "order_id", "left")
    )
    crossing = rules.interstate(
        F.col("item_count"), F.col("one_seller_state"), F.col("several_seller_states"), F.col("customer_state")
    )
    return joined.withColumn("interstate", crossing).drop("one_seller_state", "several_seller_states")


def with_durations(df: DataFrame) -> DataFrame:
    purchased, approved = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    handed, delivered = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    estimate = F.col("order_estimated_delivery_date")
    return df.withColumns(
        {
            "purchase_month": F.trunc(F.to_date(purchased), "MM"),
            "promise_days": F.datediff(F.to_date(estimate), F.to_date(purchased)),
            "lateness_days": F.datediff(F.to_date(delivered), F.to_date(estimate)),
            "delivery_days": elapsed_days(purchased, delivered),
            "handling_days": elapsed_days(approved, handed),
            "transit_days": elapsed_days(handed, delivered),
        }
    )


def with_eligibility(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "eligible",
        rules.eligible(
            F.col("order_status"),
            F.col("order_purchase_timestamp"),
            F.col("order_estimated_delivery_date"),
            F.col("order_delivered_customer_date"),
            F.col("item_count"),
        ),
    )


def with_outcomes(df: DataFrame, rule: ReviewRule = ReviewRule()) -> DataFrame:
    score = rules.post_delivery_score(
        F.col("eligible"),
        F.col("review_answer_timestamp"),
        F.col("order_delivered_customer_date"),
        F.col("review_score"),
    )
    return df.withColumns(
        {
            "on_time": rules.on_time(F.col("eligible"), F.col("lateness_days")),
            "post_delivery_score": score,
            "poor_review": rules.poor_review(score, rule),
            "basket_band": rules.basket_band(F.col("item_count")),
            "valid_stages": rules.valid_stages(F.col("handling_days"), F.col("transit_days")),
        }
    )


def build_mart(tables: Mapping[str, DataFrame], rule: ReviewRule = ReviewRule()) -> DataFrame:
    # Items of other orders find no order below.
    summary = item_summary(tables["items"], tables["products"], tables["translation"], tables["sellers"])
    context = join_order_context(
        tables["orders"], tables["customers"], summary, first_review(tables["reviews"], rule)
    )
    return with_outcomes(with_eligibility(with_durations(context)), rule)


def eligible_orders(mart: DataFrame) -> DataFrame:
    return mart.filter("eligible")


def bi_export(mart: DataFrame, columns: Sequence[str] = tuple(EXPORT_COLUMNS)) -> DataFrame:
    """Eligible orders with the allowed columns only."""
    return eligible_orders(mart).select(*columns)
