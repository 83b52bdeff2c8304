"""Data-quality contracts as DataFrames; ``enforce`` turns failed ones into an error after one action."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DIMENSION_KEYS
from .mart import eligible_orders


class ContractError(ValueError):
    """A contract that must stop the run did not hold."""


def _scalar(df: DataFrame, value: Column) -> Column:
    return df.agg(value.alias("value")).scalar()


def _one_row(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.sparkSession.range(1).select(*(c.alias(name) for name, c in columns.items()))


def _check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.coalesce(detail.cast("double"), F.lit(float("nan"))).alias("detail"),
    )


def check_key(df: DataFrame, key: str, name: str = "dimension_key") -> DataFrame:
    """Rows minus distinct non-null keys: duplicates and NULL keys both count."""
    bad = df.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("bad"))
    return _check(bad, f"{name}:{key}", F.col("bad") == 0, F.col("bad"))


def bad_keys(df: DataFrame, key: str) -> DataFrame:
    """The offending key values behind a failed ``check_key``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations held by several rows; NULL parts compare as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_natural_key(df: DataFrame, keys: Sequence[str], name: str = "natural_key") -> DataFrame:
    bad = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("bad"))
    return _check(bad, f"{name}:{'+'.join(keys)}", F.col("bad") == 0, F.col("bad"))


def check_grain(mart: DataFrame, source: DataFrame, key: str = "order_id") -> DataFrame:
    """Mart rows = distinct mart keys = source rows."""
    sizes = mart.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).withColumn(
        "expected", _scalar(source, F.count(F.lit(1)))
    )
    held = (F.col("n") == F.col("keys")) & (F.col("n") == F.col("expected"))
    return _check(sizes, "mart_grain", held, F.col("n") - F.col("expected"))


def exact_sum(column: str) -> Column:
    """Decimal total: unlike a sum of doubles it neither depends on row order nor drifts with the row count."""
    return F.sum(F.col(column).cast("decimal(28,6)"))


def check_sum(
    left: DataFrame, left_column: str, right: DataFrame, right_column: str, tolerance: float = 0.01
) -> DataFrame:
    """Two totals must agree; the detail is their difference, to six digits."""
    totals = left.agg(exact_sum(left_column).alias("left_total")).withColumn(
        "right_total", _scalar(right, exact_sum(right_column))
    )
    gap = F.col("left_total") - F.col("right_total")
    return _check(totals, "value_reconciliation", F.abs(gap) < tolerance, gap)


def check_domain(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Values outside [low, high]; NULL passes."""
    bad = df.agg(F.count_if(~F.col(column).between(low, high)).alias("bad"))
    return _check(bad, f"domain:{column}", F.col("bad") == 0, F.col("bad"))


def source_contracts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Key contracts that must hold before any join."""
    checks = [check_key(tables[name], key, f"raw_{name}") for name, key in DIMENSION_KEYS.items()]
    checks.append(check_natural_key(tables["items"], ["order_id", "order_item_id"], "raw_items"))
    return reduce(DataFrame.unionByName, checks)


def mart_contracts(mart: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Contracts that must hold before the mart is used."""
    return reduce(
        DataFrame.unionByName,
        [
            check_grain(mart, tables["orders"]),
            check_sum(tables["items"], "price", mart, "item_value_brl"),
            check_domain(tables["reviews"], "review_score", 1, 5),
        ],
    )


def enforce(checks: DataFrame) -> None:
    """Raise with the failed checks. The table has one row per check, so collecting it is safe."""
    failed = checks.filter("not passed").collect()
    if failed:
        raise ContractError("; ".join(f"{row.check_name} failed ({row.detail})" for row in failed))


def ineligible_orders(mart: DataFrame) -> DataFrame:
    return mart.agg(F.count_if(~F.coalesce("eligible", F.lit(False))).alias("ineligible_orders"))


def missing_review_eligible(mart: DataFrame) -> DataFrame:
    return eligible_orders(mart).agg(F.count_if(F.col("review_score").isNull()).alias("missing_review_eligible"))


def pre_delivery_reviews(mart: DataFrame) -> DataFrame:
    early = F.col("review_answer_timestamp") < F.col("order_delivered_customer_date")
    return eligible_orders(mart).agg(F.count_if(early).alias("pre_delivery_reviews"))


def invalid_stage_eligible(mart: DataFrame) -> DataFrame:
    return eligible_orders(mart).agg(F.count_if(~F.col("valid_stages")).alias("invalid_stage_eligible"))


def extra_review_rows(reviews: DataFrame) -> DataFrame:
    return reviews.agg((F.count(F.lit(1)) - F.count_distinct("order_id")).alias("extra_review_rows"))


def _unmatched(df: DataFrame, dimension: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose key is absent from the dimension. Counting per key first keeps a hot key out of the join."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = per_key.join(dimension.select(key), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))


def items_missing_product(items: DataFrame, products: DataFrame) -> DataFrame:
    return _unmatched(items, products, "product_id", "items_missing_product")


def orders_missing_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return _unmatched(orders, customers, "customer_id", "orders_missing_customer")


#: Column of a scanned table that names, per row, what could not be read.
UNREAD = "_unread"


def quality_report(mart: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """All controls as one row. The four mart counters share one pass over the mart.

    ``unread_values`` counts the values of all tables whose text could not be read; NULL if no table says (see ``scan_csv``).
    """
    has = F.coalesce("eligible", F.lit(False))
    counters = mart.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("order_id").alias("keys"),
            exact_sum("item_value_brl").alias("value"),
            F.count_if(~has).alias("ineligible_orders"),
            F.count_if(has & F.col("review_score").isNull()).alias("missing_review_eligible"),
            F.count_if(
                has & (F.col("review_answer_timestamp") < F.col("order_delivered_customer_date"))
            ).alias("pre_delivery_reviews"),
            F.count_if(has & ~F.col("valid_stages")).alias("invalid_stage_eligible"),
        ).alias("c")
    ).scalar()
    n = F.count(F.lit(1)).alias("n")
    unread = lambda df: F.coalesce(F.sum(F.size(UNREAD)), F.lit(0)) if UNREAD in df.columns else F.lit(None).cast("long")
    totals = tables["items"].agg(F.struct(n, exact_sum("price").alias("price"), unread(tables["items"]).alias("unread"))).scalar()
    sizes = {name: df.agg(F.struct(n, unread(df).alias("unread"))).scalar() for name, df in tables.items() if name != "items"}
    facts = mart.sparkSession.range(1).select(
        counters.alias("c"),
        totals.alias("i"),
        F.struct(*(size.alias(name) for name, size in sizes.items())).alias("raw"),
        extra_review_rows(tables["reviews"]).scalar().alias("extra_review_rows"),
        items_missing_product(tables["items"], tables["products"]).scalar().alias("items_missing_product"),
        orders_missing_customer(tables["orders"], tables["customers"]).scalar().alias("orders_missing_customer"),
    )
    gap = F.col("i.price") - F.col("c.value")
    of = lambda name, what: F.col(f"i.{what}" if name == "items" else f"raw.{name}.{what}")
    counts = [of(name, "n").alias(name) for name in tables]
    lost = F.array_compact(F.array(*(of(name, "unread") for name in tables)))
    return facts.select(
        F.struct(*counts).alias("raw_counts"),
        ((F.col("c.n") == F.col("c.keys")) & (F.col("c.n") == F.col("raw.orders.n"))).alias("order_grain_pass"),
        (F.abs(gap) < 0.01).alias("item_value_reconciled"),
        gap.cast("double").alias("item_value_difference_brl"),
        "c.ineligible_orders",
        "c.missing_review_eligible",
        "c.pre_delivery_reviews",
        "c.invalid_stage_eligible",
        "extra_review_rows",
        "items_missing_product",
        "orders_missing_customer",
        F.when(F.size(lost) > 0, F.aggregate(lost, F.lit(0).cast("long"), lambda a, x: a + x)).alias("unread_values"),
    )
