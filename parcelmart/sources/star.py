"""Source tables in the shape of ``schemas.SOURCE_SCHEMAS``, derived from star-schema sales tables.

Every lineitem is one item, every order one order. Clock times, weights, missing values and reviews are
arithmetic on the order key, so that all branches of the mart rules occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

STAR_TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]


def read_star(spark: SparkSession, directory: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet") for name in names or STAR_TABLES}


def _minutes(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), count.cast("int"))


def _days(count: Column) -> Column:
    return F.make_dt_interval(count.cast("int"))


def _order_clock(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("k"),
        "o_custkey",
        "o_orderstatus",
        F.col("o_orderdate").alias("order_day"),
        (F.col("o_orderdate") + _minutes(k * 37 % 1440)).alias("purchased"),
        (k * 13 % 2880).alias("approve_min"),
        (k * 13 % 2880 + k * 101 % 7200 - 240).alias("carrier_min"),
        (k * 211 % 28800).alias("transit_min"),
    )


def raw_orders(orders: DataFrame) -> DataFrame:
    k, purchased = F.col("k"), F.col("purchased")
    canceled = (F.col("o_orderstatus") == "P") & (k % 4 == 0)
    arrival = purchased + _minutes(F.col("carrier_min") + F.col("transit_min") + 240)
    return _order_clock(orders).select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(canceled, "canceled").otherwise("delivered").alias("order_status"),
        purchased.alias("order_purchase_timestamp"),
        F.when(k % 97 != 0, purchased + _minutes(F.col("approve_min"))).alias("order_approved_at"),
        F.when(k % 89 != 0, purchased + _minutes(F.col("carrier_min"))).alias("order_delivered_carrier_date"),
        F.when(canceled | (k % 101 == 0), None)
        .when(k % 113 == 0, purchased - _days(F.lit(1)))
        .otherwise(arrival)
        .alias("order_delivered_customer_date"),
        (F.col("order_day") + _days(F.when(k % 127 == 0, -1).otherwise(12 + k * 7 % 15))).alias(
            "order_estimated_delivery_date"
        ),
    )


def raw_reviews(orders: DataFrame) -> DataFrame:
    """No, one or two reviews per order, generated from one read of the orders."""
    k, purchased = F.col("k"), F.col("purchased")
    arrival_min = F.col("carrier_min") + F.col("transit_min") + 240
    answer_min = arrival_min + k * 53 % 10080 - 1440

    first, second = k % 20 != 0, k % 11 == 0
    written = (
        F.when(first & second, F.array(F.lit("a"), F.lit("b")))
        .when(first, F.array(F.lit("a")))
        .when(second, F.array(F.lit("b")))
    )
    is_first = F.col("kind") == "a"
    return (
        _order_clock(orders)
        .withColumn("kind", F.explode(written))
        .select(
            F.concat("kind", k.cast("string")).alias("review_id"),
            k.alias("order_id"),
            F.when(is_first, 1 + (k * 17 + k % 7) % 5).otherwise(1 + k % 5).cast("int").alias("review_score"),
            (purchased + _minutes(arrival_min)).alias("review_creation_date"),
            F.when(~is_first | (k % 53 != 0), purchased + _minutes(answer_min + F.when(is_first, 0).otherwise((k % 3 - 1) * 600))).alias(
                "review_answer_timestamp"
            ),
        )
    )


def raw_items(lineitem: DataFrame) -> DataFrame:
    """Line numbers repeat in the input, so a fresh one is counted; the window is pruned where it is unused."""
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.row_number().over(line).alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100) / F.lit(100.0)).alias("freight_value"),
    )


def source_tables(star: dict[str, DataFrame]) -> dict[str, DataFrame]:
    nation = star["nation"].select("n_nationkey", "n_name")
    part = star["part"]
    key = F.col("p_partkey")
    return {
        "orders": raw_orders(star["orders"]),
        "items": raw_items(star["lineitem"]),
        "reviews": raw_reviews(star["orders"]),
        "customers": star["customer"]
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state")),
        "products": part.select(
            key.alias("product_id"),
            F.when(key % 29 != 0, F.col("p_type")).alias("product_category_name"),
            F.when(key % 37 != 0, F.col("p_size") * 100).alias("product_weight_g"),
        ),
        "sellers": star["supplier"]
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")),
        "translation": part.filter(F.col("p_type") != "PROMO")
        .select(
            F.col("p_type").alias("product_category_name"),
            F.lower("p_type").alias("product_category_name_english"),
        )
        .distinct(),
    }


def load_sources(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return source_tables(read_star(spark, directory))
