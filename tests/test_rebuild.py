import json
import os

import pytest

from conftest import SHOP
from parcelmart.operators import contracts, features, kpis
from parcelmart.plans import registry, rebuild
from parcelmart.sources import readers, staging, star

DATA = "/root/testdata/sf0.01"


def _json(path):
    return json.loads("".join(p.read_text() for p in path.glob("part-*.json")))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_all_reports_are_written(spark, tmp_path):
    tables = {name: staging.stage(df, name) for name, df in star.load_sources(spark, DATA).items()}
    folder = os.path.dirname(staging.fresh_path(spark, "x"))
    before = set(os.listdir(folder))
    orders = rebuild.rebuild(tables, str(tmp_path), registry.CUTOFFS, registry.MIN_FREQUENCY, raw_path=DATA)
    assert {p.name for p in tmp_path.iterdir()} == {
        "order_analysis", "order_analysis_parquet", "orders_by_month", "summary", "quality", "monthly_kpis",
        "review_sensitivity", "states", "categories", "baskets", "eta_scenarios", "cost_scenarios", "thresholds",
        "calibration", "model_coefficients", "model_predictions", "model_metrics", "view_cards", "view_monthly",
        "view_top_categories", "view_lateness_bands", "delivery_events", "event_intervals", "data_manifest",
    }
    summary = _json(tmp_path / "summary")
    headline = kpis.headline(orders).first()
    assert summary["hidden_failure_orders"] == headline.hidden_failure_orders
    assert summary["bootstrap_gap"]["ci_low"] < summary["bootstrap_gap"]["difference"] < summary["bootstrap_gap"]["ci_high"]
    assert [g["group"] for g in summary["review_sensitivity"]] == ["on_time", "late"]
    assert summary["raw_orders"] == tables["orders"].count()
    model = _json(tmp_path / "model_metrics")
    assert summary["model"] == model
    assert [m["model"] for m in model["metrics"]] == ["logistic", "training_prevalence"]
    assert (model["false_positive_cost_assumed"], model["false_negative_cost_assumed"]) == (3, 25)
    assert model["features"] == features.NUMERIC + features.CATEGORICAL
    assert min(model["splits"].values()) >= 100
    events = spark.read.parquet(str(tmp_path / "delivery_events"))
    assert spark.read.parquet(str(tmp_path / "event_intervals")).count() == events.count() >= summary["raw_orders"]
    hashes = spark.read.json(str(tmp_path / "data_manifest"))
    assert {r.file: r.bytes for r in hashes.collect()} == {f: os.path.getsize(f"{DATA}/{f}") for f in os.listdir(DATA)}
    staged = set(os.listdir(folder)) - before
    assert not [name for name in staged if name.startswith(("model-rows", "model-scores", "model-block", "summary"))]
    assert _json(tmp_path / "quality")["raw_counts"]["orders"] == tables["orders"].count()
    assert readers.scan_csv(spark, str(tmp_path / "thresholds")).count() == 99
    assert readers.scan_parquet(spark, str(tmp_path / "orders_by_month")).count() == headline.eligible_orders


def test_a_failed_contract_writes_nothing(make_tables, tmp_path):
    tables = make_tables(**{**SHOP, "sellers": [*SHOP["sellers"], ("depot", "PA")]})
    with pytest.raises(contracts.ContractError, match="raw_sellers"):
        rebuild.rebuild(tables, str(tmp_path / "reports"))
    assert not (tmp_path / "reports").exists()
