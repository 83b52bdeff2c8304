"""Delay-model inputs known at carrier handoff, chronological splits, and preprocessing fitted on one split."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import elapsed_days
from .contracts import ContractError
from .mart import eligible_orders
from .quantiles import exact_percentiles

# Model inputs. None of them is known only after handoff.
NUMERIC = [
    "promise_remaining_days",
    "handling_days",
    "item_count",
    "seller_count",
    "log_item_value",
    "freight_charged_brl",
    "mean_weight_g",
    "interstate",
]
CATEGORICAL = ["customer_state", "category"]
SPLITS = ["train", "validation", "test"]
INFREQUENT = "infrequent"


@dataclass(frozen=True)
class SplitCutoffs:
    """End of each handoff window, and the time by which test labels must exist."""

    train_end: datetime = datetime(2018, 4, 1)
    validation_end: datetime = datetime(2018, 6, 1)
    test_end: datetime = datetime(2018, 8, 1)
    test_matured_by: datetime = datetime(2018, 9, 1)


def model_features(mart: DataFrame) -> DataFrame:
    handed = F.col("order_delivered_carrier_date")
    deadline = F.to_date("order_estimated_delivery_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1))
    return (
        eligible_orders(mart)
        .filter(F.col("valid_stages") & handed.isNotNull())
        .withColumns(
            {
                "promise_remaining_days": elapsed_days(handed, deadline),
                "log_item_value": F.log1p("item_value_brl"),
                "target": (~F.col("on_time")).cast("int"),
            }
        )
    )


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def temporal_splits(df: DataFrame, cutoffs: SplitCutoffs = SplitCutoffs()) -> DataFrame:
    """Add ``split`` by handoff window. Rows whose label was not known before the next window starts are dropped."""
    handed, delivered = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    train_end, validation_end, test_end = map(
        _moment, (cutoffs.train_end, cutoffs.validation_end, cutoffs.test_end)
    )
    split = (
        F.when((handed < train_end) & (delivered < train_end), "train")
        .when((handed >= train_end) & (handed < validation_end) & (delivered < validation_end), "validation")
        .when(
            (handed >= validation_end) & (handed < test_end) & (delivered < _moment(cutoffs.test_matured_by)), "test"
        )
    )
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def split_sizes(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows and classes of every split, empty ones included."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in SPLITS))).alias("split"))
    sizes = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes"))
    return names.join(sizes, "split", "left").fillna(0, ["n", "classes"])


def check_splits(df: DataFrame, min_n: int = 100, label: str = "target") -> dict[str, int]:
    """Sizes of the three splits; an error if one is too small or holds a single class."""
    sizes = {row["split"]: row for row in split_sizes(df, label).collect()}
    weak = [s for s in SPLITS if sizes[s]["n"] < min_n or sizes[s]["classes"] != 2]
    if weak:
        raise ContractError(f"too few matured rows or a single class in: {', '.join(weak)}")
    return {s: sizes[s]["n"] for s in SPLITS}


def medians(df: DataFrame, columns: Sequence[str] = tuple(NUMERIC)) -> DataFrame:
    """One row per column with its exact median; a column without values has no row."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return exact_percentiles(df.select(F.inline(pairs)), F.col("value"), {"median": 0.5}, ["feature"], few=True)


def fill_missing(df: DataFrame, fills: dict[str, float], categorical: Sequence[str] = tuple(CATEGORICAL)) -> DataFrame:
    numeric = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()}
    named = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in categorical}
    return df.withColumns({**numeric, **named})


def impute(df: DataFrame, fit_on: DataFrame, columns: Sequence[str] = tuple(NUMERIC)) -> DataFrame:
    """Fill numeric gaps with the medians of ``fit_on`` and missing categories with ``unknown``."""
    return fill_missing(df, {row["feature"]: row["median"] for row in medians(fit_on, columns).collect()})


def scaling(df: DataFrame, columns: Sequence[str] = tuple(NUMERIC)) -> DataFrame:
    """One row: mean and population standard deviation per column, as ``<column>_mean`` and ``<column>_std``."""
    return df.agg(
        *(F.avg(c).alias(f"{c}_mean") for c in columns), *(F.stddev_pop(c).alias(f"{c}_std") for c in columns)
    )


def standardize(df: DataFrame, fit_on: DataFrame, columns: Sequence[str] = tuple(NUMERIC)) -> DataFrame:
    """Z-scores with the mean and population deviation of ``fit_on``; a constant column becomes 0."""
    fitted = scaling(fit_on, columns).first()
    return df.withColumns(
        {
            c: (F.col(c).cast("double") - F.lit(fitted[f"{c}_mean"])) / F.lit(fitted[f"{c}_std"] or 1.0)
            for c in columns
        }
    )


def vocabulary(
    fit_on: DataFrame, min_frequency: int = 50, columns: Sequence[str] = tuple(CATEGORICAL)
) -> DataFrame:
    """Category values of ``fit_on`` with their output position per feature.

    Values seen less than ``min_frequency`` times share the last position, called ``infrequent``.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = (
        fit_on.select(F.inline(pairs))
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rare", F.col("n") < min_frequency)
    )
    # Only frequent values are ranked, at most rows / min_frequency of them.
    order = Window.partitionBy("feature").orderBy("value")
    frequent = counts.filter(~F.col("rare")).withColumn("place", F.row_number().over(order) - 1)
    sizes = counts.groupBy("feature").agg(F.count_if(~F.col("rare")).alias("place"))
    placed = frequent.unionByName(counts.filter("rare").join(sizes, "feature"))
    return placed.select(
        "feature",
        "value",
        "n",
        F.when(F.col("rare"), INFREQUENT).otherwise(F.col("value")).alias("label"),
        F.col("place").cast("bigint").alias("place"),
    )
