import pytest

from conftest import SHOP, order
from parcelmart.operators import contracts as Q
from parcelmart.operators.mart import build_mart


def _checks(df):
    return {r.check_name: (r.passed, r.detail) for r in df.collect()}


def test_clean_sources_pass(shop):
    Q.enforce(Q.source_contracts(shop))
    Q.enforce(Q.mart_contracts(build_mart(shop), shop))


@pytest.mark.parametrize("extra", [("north", "CE"), (None, "CE")])
def test_duplicate_or_null_key_stops_the_run(make_tables, extra):
    tables = make_tables(**{**SHOP, "customers": [*SHOP["customers"], extra]})
    with pytest.raises(Q.ContractError, match="raw_customers"):
        Q.enforce(Q.source_contracts(tables))
    assert Q.bad_keys(tables["customers"], "customer_id").count() == 1


def test_duplicate_natural_key(make_tables):
    item = SHOP["items"][0]
    tables = make_tables(**{**SHOP, "items": SHOP["items"] + [item]})
    with pytest.raises(Q.ContractError, match="raw_items"):
        Q.enforce(Q.source_contracts(tables))
    assert [tuple(r) for r in Q.duplicate_keys(tables["items"], ["order_id", "order_item_id"]).collect()] == [("basket", 1, 2)]


def test_null_key_parts_group_together(make_tables):
    tables = make_tables(items=[("a", None, "p", "s", 1.0, 0.0)])
    assert Q.duplicate_keys(tables["items"], ["order_id", "order_item_id"]).count() == 0
    tables = make_tables(items=[("a", None, "p", "s", 1.0, 0.0)] * 2)
    assert Q.duplicate_keys(tables["items"], ["order_id", "order_item_id"]).count() == 1


def test_orphan_items_break_reconciliation(make_tables):
    orphan = ("nowhere", 1, "lamp", "depot", 7.25, 0.0)
    tables = make_tables(**{**SHOP, "items": SHOP["items"] + [orphan]})
    checks = _checks(Q.mart_contracts(build_mart(tables), tables))
    assert checks["value_reconciliation"] == (False, 7.25)
    assert checks["mart_grain"] == (True, 0.0)


def test_repeated_order_breaks_the_grain(make_tables):
    tables = make_tables(**{**SHOP, "orders": SHOP["orders"] + [SHOP["orders"][0]]})
    assert _checks(Q.mart_contracts(build_mart(tables), tables))["mart_grain"][0] is False


def test_score_domain_lets_null_pass(make_tables):
    reviews = [("r", "a", None, None, None), ("s", "a", 5, None, None)]
    assert _checks(Q.check_domain(make_tables(reviews=reviews)["reviews"], "review_score", 1, 5)) == {
        "domain:review_score": (True, 0.0)
    }
    bad = make_tables(reviews=reviews + [("t", "a", 6, None, None)])["reviews"]
    assert _checks(Q.check_domain(bad, "review_score", 1, 5)) == {"domain:review_score": (False, 1.0)}


def test_empty_totals_do_not_pass_silently(make_tables):
    tables = make_tables()
    assert _checks(Q.mart_contracts(build_mart(tables), tables))["value_reconciliation"][0] is False


def test_quality_report(make_tables):
    tables = make_tables(
        **{
            **SHOP,
            "items": SHOP["items"] + [("basket", 4, "gone", "depot", 1.0, 0.0), ("basket", 5, None, "depot", 1.0, 0.0)],
            "orders": SHOP["orders"] + [order("f", delivered="2018-01-03", customer="stranger")],
        }
    )
    row = Q.quality_report(build_mart(tables), tables).first()
    assert row.raw_counts.asDict() == {
        "orders": 7, "items": 10, "reviews": 5, "customers": 2, "products": 3, "sellers": 2, "translation": 1,
    }
    assert row.order_grain_pass and row.item_value_reconciled and row.item_value_difference_brl == 0
    assert (row.ineligible_orders, row.missing_review_eligible, row.pre_delivery_reviews) == (3, 1, 1)
    assert (row.invalid_stage_eligible, row.extra_review_rows) == (0, 2)
    assert (row.items_missing_product, row.orders_missing_customer) == (2, 1)
    assert row.unread_values is None
