"""Metric rules of one order. All of them keep NULL apart from false: NULL means "not known or not applicable"."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReviewRule:
    lowest: int = 1
    highest: int = 5
    poor_max: int = 2


def eligible(status: Column, purchased: Column, estimate: Column, delivered: Column, items: Column) -> Column:
    """Three-valued: false as soon as one test fails, NULL when no test fails but some value is missing."""
    return (
        (status == "delivered")
        & purchased.isNotNull()
        & (estimate >= F.to_date(purchased))
        & (delivered >= purchased)
        & (items > 0)
    )


def on_time(is_eligible: Column, lateness_days: Column) -> Column:
    return F.when(is_eligible, lateness_days <= 0)


def post_delivery_score(is_eligible: Column, answered: Column, delivered: Column, score: Column) -> Column:
    return F.when(is_eligible & (answered >= delivered), score)


def poor_review(post_score: Column, rule: ReviewRule = ReviewRule()) -> Column:
    return post_score <= rule.poor_max


def basket_band(items: Column) -> Column:
    return F.when(items == 1, "1 item").when(items > 1, "2+ items").otherwise("unknown")


def valid_stages(handling: Column, transit: Column) -> Column:
    return F.coalesce((handling >= 0) & (transit >= 0), F.lit(False))


def interstate(items: Column, seller_state: Column, several_states: Column, customer_state: Column) -> Column:
    """1 if any seller state differs from the customer's: always so when the sellers sit in several states."""
    differs = customer_state.isNotNull() & (several_states | (seller_state != customer_state))
    return F.when(items.isNotNull(), F.coalesce(differs, F.lit(False)).cast("int"))
