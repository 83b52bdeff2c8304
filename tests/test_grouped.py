import hashlib
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmart.operators import kpis, replay, resample, scenarios, segments, views


def test_small_segment_leaves_an_empty_typed_table(outcomes):
    table = segments.segment_table(outcomes([{"poor_review": True}]), "category", min_n=30)
    assert table.columns == ["segment", "reviewed_on_time", "hidden_failures", "rate", "ci_low", "ci_high"]
    assert table.count() == 0


def test_segment_at_the_minimum_stays_and_null_keys_drop(outcomes):
    rows = [{"category": "a", "poor_review": i == 0} for i in range(3)]
    rows += [{"category": "b", "poor_review": True}] * 2 + [{"category": None, "poor_review": True}] * 5
    rows += [{"category": "a", "poor_review": None}, {"category": "a", "poor_review": True, "on_time": False}]
    got = segments.segment_table(outcomes(rows), "category", min_n=3).collect()
    assert [(r.segment, r.reviewed_on_time, r.hidden_failures) for r in got] == [("a", 3, 1)]


def test_segments_with_equal_counts_sort_by_name(outcomes):
    rows = [{"category": c, "poor_review": True} for c in "cab"]
    assert [r.segment for r in segments.segment_table(outcomes(rows), "category", 1).collect()] == ["a", "b", "c"]
    assert [r.segment for r in kpis.top_segments(segments.segment_table(outcomes(rows), "category", 1), 2).collect()] == ["a", "b"]


def test_month_without_reviews_has_no_rate(outcomes):
    row = kpis.monthly_kpis(outcomes([{"delivery_days": 1.0}, {"delivery_days": 2.0, "on_time": False}])).first()
    assert (row.orders, row.on_time_orders, row.late_orders, row.reviewed_orders) == (2, 1, 1, 0)
    assert row.hidden_failure_rate is None and row.on_time_rate == 0.5
    assert row.p90_delivery_days == pytest.approx(1.9)


def test_headline_of_no_orders(outcomes):
    row = kpis.headline(outcomes([{"eligible": False}])).first()
    assert row.eligible_orders == 0 and row.on_time_rate is None and row.hidden_failure_ci_low is None


def test_review_sensitivity(outcomes):
    rows = [
        {"poor_review": True, "review_score": 1},
        {"poor_review": None, "review_score": 5},
        {"on_time": False, "review_score": 2},
        {"on_time": False, "review_score": None},
    ]
    got = [tuple(r) for r in kpis.review_sensitivity(outcomes(rows)).collect()]
    assert got == [("on_time", 2, 0.5, 1.0, 2, 0.5), ("late", 2, 0.0, None, 1, 1.0)]


def test_later_deadlines_relabel_without_moving_deliveries(outcomes):
    late = [-1, 0, 1, 4, 8]
    got = scenarios.eta_scenarios(outcomes([{"lateness_days": d, "on_time": d <= 0} for d in late])).collect()
    assert [r.extension_days_assumed for r in got] == [0, 1, 2, 3, 5, 7]
    assert got[0].reclassified_orders == 0 and got[-1].reclassified_orders == 2
    rates = [r.rescored_on_time_rate for r in got]
    assert rates == sorted(rates) and rates[0] == got[0].recorded_on_time_rate
    assert {r.evidence for r in got} == {"scenario_only"}


def test_cost_uses_only_on_time_observed_poor_reviews(outcomes):
    flags = [(True, True), (True, False), (False, True), (True, None)]
    got = scenarios.cost_scenarios(outcomes([{"on_time": o, "poor_review": p} for o, p in flags])).collect()
    assert len(got) == 9 and {r.hidden_failure_orders for r in got} == {1}
    assert [r.negative_proxy_orders for r in got if r.margin_assumed == 0.1 and r.recovery_brl_assumed == 25] == [1]
    empty = scenarios.cost_scenarios(outcomes([{}])).collect()
    assert {r.proxy_contribution_brl for r in empty} == {0.0}


def test_weeks_run_from_monday_to_sunday(outcomes):
    days = [datetime(2018, 1, 7, 23, 59), datetime(2018, 1, 8), datetime(2018, 1, 14)]
    rows = [{"order_purchase_timestamp": d, "poor_review": True} for d in days]
    got = {r.week: r.on_time_n for r in segments.weekly_cluster_counts(outcomes(rows)).collect()}
    assert got == {date(2018, 1, 1): 1, date(2018, 1, 8): 2}


def test_bootstrap_equals_a_plain_loop_over_the_same_draws(spark):
    rng = np.random.default_rng(4)
    weeks = [(date(2018, 1, 1) + timedelta(weeks=w), *(int(v) for v in rng.integers(0, 5, 2)), *(int(v) for v in rng.integers(0, 9, 2))) for w in range(9)]
    weeks = [(d, min(a, b), max(a, b), min(c, e), max(c, e)) for d, a, b, c, e in weeks]
    weeks[2] = (weeks[2][0], 0, 0, 0, 4)
    df = spark.createDataFrame(weeks, "week date, late_poor long, late_n long, on_time_poor long, on_time_n long").repartition(3)
    got = resample.cluster_bootstrap_gap(df, iterations=200, seed=7).first()

    def gap(picks):
        lp, ln, op, on = (sum(weeks[p][c] for p in picks) for c in (1, 2, 3, 4))
        return lp / ln - op / on if ln and on else None

    def draw(i, j):
        return int(hashlib.md5(f"7-{i}-{j}".encode()).hexdigest()[:8], 16) % 9

    gaps = [g for i in range(200) if (g := gap([draw(i, j) for j in range(9)])) is not None]
    assert got.difference == pytest.approx(gap(range(9)))
    assert (got.ci_low, got.ci_high) == (pytest.approx(np.quantile(gaps, 0.025)), pytest.approx(np.quantile(gaps, 0.975)))


def test_bootstrap_of_no_weeks(spark):
    df = spark.createDataFrame([], "week date, late_poor long, late_n long, on_time_poor long, on_time_n long")
    assert resample.cluster_bootstrap_gap(df, 10).first().difference is None


def _band(state, band, n, k):
    return [{"customer_state": state, "basket_band": band, "poor_review": i < k} for i in range(n)]


def test_standardization_reverses_a_confounded_gap(outcomes):
    rows = _band("A", "1 item", 80, 8) + _band("A", "2+ items", 20, 1)
    rows += _band("B", "1 item", 20, 12) + _band("B", "2+ items", 80, 40) + _band("C", "1 item", 50, 0)
    got = segments.direct_standardization(outcomes(rows), min_n=20).first()
    assert got.common_states == 2
    assert got.crude_single == pytest.approx(20 / 150) and got.crude_multi == pytest.approx(41 / 100)
    assert got.standardized_single == pytest.approx(0.5 * 0.1 + 0.5 * 0.6)
    assert got.standardized_multi == pytest.approx(0.5 * 0.05 + 0.5 * 0.5)
    assert got.sign_reversal is True


def test_standardization_without_common_states(outcomes):
    got = segments.direct_standardization(outcomes(_band("A", "1 item", 40, 4) + _band(None, "2+ items", 40, 4))).first()
    assert got.common_states == 0 and got.standardized_single is None and got.sign_reversal is None
    assert got.crude_multi == pytest.approx(0.1)


def test_views_count_rows_without_state_in_the_total_only(outcomes):
    rows = [{"customer_state": "A", "poor_review": True, "lateness_days": 0}, {"customer_state": None, "lateness_days": 5, "on_time": False}]
    cards = {r.state_view: r for r in views.view_cards(outcomes(rows)).collect()}
    assert set(cards) == {"All states", "A"}
    assert (cards["All states"].n, cards["All states"].on_time, cards["All states"].coverage) == (2, 0.5, 0.5)
    assert cards["A"].rate == 1.0 and cards["A"].ci_high == 1.0
    bands = {(r.state_view, r.low_days): r.orders for r in views.view_lateness_bands(outcomes(rows)).collect()}
    assert bands[("All states", -1000)] == 1 and bands[("All states", 4)] == 1 and bands[("A", 4)] == 0
    monthly = {r.state_view: r for r in views.view_monthly(outcomes(rows)).collect()}
    assert monthly["All states"].n == 2 and monthly["All states"].hidden == 1.0


def test_top_categories_keep_k_per_view(outcomes):
    rows = [{"category": f"c{i:02d}", "poor_review": j < i, "customer_state": "A"} for i in range(12) for j in range(12)]
    got = views.view_top_categories(outcomes(rows), k=10, min_n=12).collect()
    assert len(got) == 20
    assert [r.segment for r in sorted(got, key=lambda r: r.position) if r.state_view == "A"] == [f"c{i:02d}" for i in range(11, 1, -1)]


@pytest.mark.parametrize("repeats", [0, 101])
def test_replay_bounds(outcomes, repeats):
    with pytest.raises(ValueError):
        replay.replay(outcomes([{}]), repeats)


def test_replay_multiplies_every_group(outcomes):
    source = outcomes([{"customer_state": s, "on_time": o} for s, o in [("A", True), ("A", False), ("B", True), (None, False)]])
    replayed = replay.replay(source, 5)
    assert replayed.count() == 20 and replayed.select("replay_id").distinct().count() == 5
    assert tuple(replay.replay_check(source, replayed, repeats=5).first()) == (3, 0, True)
    broken = replayed.filter(~((F.col("replay_id") == 3) & F.col("customer_state").eqNullSafe("B")))
    assert tuple(replay.replay_check(source, broken, repeats=5).first()) == (3, 1, False)
