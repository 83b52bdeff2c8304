"""The full rebuild: check the sources, build the mart once, then write every report from it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.inference import sample_size
from ..operators import (
    contracts,
    delay_model,
    events,
    features,
    kpis,
    mart,
    resample,
    scenarios,
    scoring,
    segments,
    views,
)
from ..operators.features import SplitCutoffs
from ..sources import readers, sinks, staging

# Independent reports submitted to Spark at the same time, so small final stages overlap with larger scans.
CONCURRENT_REPORTS = 8

Stage = Callable[[DataFrame, str], DataFrame]


def summary(orders: DataFrame, raw_orders: DataFrame, min_stratum: int = 30) -> DataFrame:
    """Raw orders, headline, bootstrap gap, standardization, sensitivity and experiment size as one nested row."""
    headline = kpis.headline(orders)
    rate = F.col("hidden_failure_rate")
    whole = lambda df: df.select(F.struct("*")).scalar()
    sensitivity = kpis.review_sensitivity(orders)
    return headline.withColumns(
        {
            "raw_orders": raw_orders.agg(F.count(F.lit(1))).scalar(),
            "bootstrap_gap": whole(resample.cluster_bootstrap_gap(segments.weekly_cluster_counts(orders))),
            "standardization": whole(segments.direct_standardization(orders, min_n=min_stratum)),
            "experiment_sample_per_arm": sample_size(rate, rate * 0.8),
            "review_sensitivity": sensitivity.agg(F.collect_list(F.struct("*"))).scalar(),
        }
    )


def _reports(orders: DataFrame, tables: Mapping[str, DataFrame], out: str) -> list[Callable[[], None]]:
    csv = lambda name, df: lambda: sinks.write(df, f"{out}/{name}", "csv")
    export = mart.bi_export(orders)
    return [
        lambda: sinks.write(export, f"{out}/order_analysis_parquet", "parquet"),
        lambda: sinks.write_by_month(export, f"{out}/orders_by_month"),
        csv("order_analysis", export),
        lambda: sinks.write(events.unpivot_events(tables["orders"]), f"{out}/delivery_events", "parquet"),
        lambda: sinks.write(events.order_event_intervals(tables["orders"]), f"{out}/event_intervals", "parquet"),
        lambda: sinks.write_json(contracts.quality_report(orders, tables), f"{out}/quality"),
        csv("monthly_kpis", kpis.monthly_kpis(orders).orderBy("purchase_month")),
        csv("review_sensitivity", kpis.review_sensitivity(orders)),
        csv("states", segments.segment_table(orders, "customer_state")),
        csv("categories", segments.segment_table(orders, "category")),
        csv("baskets", segments.segment_table(orders, "basket_band")),
        csv("eta_scenarios", scenarios.eta_scenarios(orders)),
        csv("cost_scenarios", scenarios.cost_scenarios(orders)),
    ]


def _dashboard(orders: DataFrame, out: str) -> list[Callable[[], None]]:
    parts = {
        "view_cards": views.view_cards(orders),
        "view_monthly": views.view_monthly(orders),
        "view_top_categories": views.view_top_categories(orders),
        "view_lateness_bands": views.view_lateness_bands(orders),
    }
    return [lambda n=n, df=df: sinks.write(df, f"{out}/{n}", "csv") for n, df in parts.items()]


def delay_reports(
    orders: DataFrame, out: str, cutoffs: SplitCutoffs, min_frequency: int, stage: Stage = staging.stage
) -> DataFrame:
    """Fit on the training window, choose the threshold on validation, evaluate once on the test window.

    Returns the model's block of the summary, staged.
    """
    rows = features.temporal_splits(features.model_features(orders), cutoffs).select(
        "order_id", "order_delivered_carrier_date", "split", "target", *features.NUMERIC, *features.CATEGORICAL
    )
    rows = stage(rows, "model-rows")
    features.check_splits(rows)
    split = {name: rows.filter(F.col("split") == name) for name in features.SPLITS}
    model = delay_model.fit(split["train"], min_frequency=min_frequency)
    kept = ["order_id", "order_delivered_carrier_date", "split", "target", "probability"]
    scored = stage(delay_model.score(model, rows.filter("split <> 'train'")).select(*kept), "model-scores")
    validation, test = (scored.filter(F.col("split") == name) for name in ("validation", "test"))
    sweep = scoring.threshold_sweep(validation, "target", "probability")
    threshold = scoring.best_threshold(sweep).select("threshold").scalar()
    blocks: list[DataFrame] = []

    def metrics() -> None:
        report = delay_model.model_report(split["train"], validation, test)
        blocks.append(stage(delay_model.model_block(report), "model-block"))
        sinks.write_json(blocks[0], f"{out}/model_metrics")

    _run(
        [
            metrics,
            lambda: sinks.write(sweep, f"{out}/thresholds", "csv"),
            lambda: sinks.write(scoring.calibration(test, "target", "probability"), f"{out}/calibration", "csv"),
            lambda: sinks.write(delay_model.coefficients(model, orders), f"{out}/model_coefficients", "csv"),
            lambda: sinks.write(delay_model.predictions(test, threshold), f"{out}/model_predictions", "csv"),
        ]
    )
    return blocks[0]


def _run(actions: list[Callable[[], None]]) -> None:
    with ThreadPoolExecutor(CONCURRENT_REPORTS) as pool:
        for done in [pool.submit(action) for action in actions]:
            done.result()


def rebuild(
    tables: Mapping[str, DataFrame],
    out: str,
    cutoffs: SplitCutoffs = SplitCutoffs(),
    min_frequency: int = 50,
    dashboard: bool = True,
    raw_path: str | None = None,
) -> DataFrame:
    """Write all reports under ``out`` and return the staged mart. A failed contract stops before any report.

    The source contracts are checked while the mart is staged; nobody reads it before they hold. With ``raw_path``, the
    folder of the raw files, their hashes are written too. What else was staged on the way is deleted.
    """
    with ThreadPoolExecutor(1) as pool:
        checked = pool.submit(lambda: contracts.enforce(contracts.source_contracts(tables)))
        orders = staging.stage(mart.build_mart(tables), "mart")
        checked.result()
    contracts.enforce(contracts.mart_contracts(orders, tables))
    actions = _reports(orders, tables, out) + (_dashboard(orders, out) if dashboard else [])
    spark = orders.sparkSession
    if raw_path:
        actions.append(lambda: sinks.write_json(readers.source_manifest(spark, raw_path), f"{out}/data_manifest"))
    with staging.temporary(spark) as stage:
        parts: dict[str, DataFrame] = {}

        def delay() -> None:
            parts["model"] = delay_reports(orders, out, cutoffs, min_frequency, stage)

        def headline() -> None:
            parts["summary"] = stage(summary(orders, tables["orders"]), "summary")

        _run([delay, headline, *actions])
        model = parts["model"].select(F.struct("*")).scalar()
        sinks.write_json(parts["summary"].withColumn("model", model), f"{out}/summary")
    return orders
