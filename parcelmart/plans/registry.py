"""Every operator as a runnable query over a directory of star-schema Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.inference import error_cost, wilson_high, wilson_low
from ..operators import (
    contracts,
    delay_model,
    events,
    features,
    kpis,
    mart,
    quantiles,
    replay,
    resample,
    scenarios,
    scoring,
    segments,
    views,
)
from ..sources import readers, sinks, staging, star

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Windows that fit the order dates of the star-schema tables.
CUTOFFS = features.SplitCutoffs(
    datetime(2000, 1, 1), datetime(2000, 10, 1), datetime(2001, 7, 1), datetime(2001, 8, 1)
)
MIN_FREQUENCY = 300
MIN_STRATUM = 10

_staged: dict[tuple, DataFrame] = {}


def _content(spark: SparkSession, directory: str) -> tuple:
    """Number, bytes and last change of the input files, so that changed input is staged anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return tuple(files.load(directory).agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first())


def _once(spark: SparkSession, directory: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, directory, name, _content(spark, directory))
    if key not in _staged:
        _staged[key] = staging.stage(build(), name)
    return _staged[key]


def staged_mart(spark: SparkSession, directory: str) -> DataFrame:
    """The mart, written once per application: about thirty reports read a few of its columns each."""
    return _once(spark, directory, "mart", lambda: mart.build_mart(star.load_sources(spark, directory)))


def _split_features(spark: SparkSession, directory: str) -> DataFrame:
    return features.temporal_splits(features.model_features(staged_mart(spark, directory)), CUTOFFS)


def _split(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return _split_features(spark, directory).filter(F.col("split") == name)


def scored_orders(spark: SparkSession, directory: str) -> DataFrame:
    """A deterministic score with ties, so that score evaluation can be compared without a trained model."""
    remaining = F.greatest(F.col("promise_remaining_days"), F.lit(0.0))
    return _split_features(spark, directory).select(
        "order_id", "split", F.col("target").alias("label"), (F.lit(1.0) / (F.lit(1.0) + remaining)).alias("score")
    )


# Whole numbers and flags that may be NULL; they travel as doubles, which every client reads alike.
NULLABLE = {
    "category_count",
    "eligible",
    "interstate",
    "item_count",
    "lateness_days",
    "on_time",
    "poor_review",
    "post_delivery_score",
    "review_score",
    "seller_count",
    "sign_reversal",
    "sample_per_arm",
}


def portable(df: DataFrame) -> DataFrame:
    """Plain column types that any engine shares: text for dates, 0/1 for flags, doubles rounded to six digits."""

    def plain(name: str, kind: T.DataType) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            return value.cast("string")
        if isinstance(kind, (T.BooleanType, T.IntegralType)):
            return value.cast("int" if isinstance(kind, T.BooleanType) else "bigint").cast(
                "double" if name in NULLABLE else "bigint"
            )
        if isinstance(kind, T.FractionalType):
            return F.round(value.cast("double"), 6) + F.lit(0.0)
        return value

    return df.select(*(plain(f.name, f.dataType).alias(f.name) for f in df.schema))


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, directory: portable(build(spark, directory))
        return build

    return register


def _on_mart(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, directory: build(staged_mart(spark, directory)))


def _on_sources(name: str, build: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    query(name)(lambda spark, directory: build(star.load_sources(spark, directory)))


# ---- sources and sinks -------------------------------------------------------------------------------------


@query("scan_csv")
def _(spark, directory):
    items = star.load_sources(spark, directory)["items"]
    path = staging.fresh_path(spark, "query-items-csv")
    sinks.write(items, path, "csv")
    return readers.scan_csv(spark, path, items.schema)


@query("scan_csv_mixed_headers")
def _(spark, directory):
    items = star.load_sources(spark, directory)["items"]
    path = staging.fresh_path(spark, "query-items-mixed-csv")
    odd = F.pmod(F.xxhash64("order_id"), F.lit(2)) == 1
    sinks.write(items.filter(odd), f"{path}/a", "csv")
    sinks.write(items.filter(~odd).select(*reversed(items.columns)), f"{path}/b", "csv")
    return readers.scan_csv(spark, f"{path}/*", items.schema).select(*items.columns)


@query("percentiles_by_customer")
def _(spark, directory):
    delivered = staged_mart(spark, directory).filter(F.col("customer_id").isNotNull() & F.col("delivery_days").isNotNull())
    return quantiles.exact_percentiles(delivered, F.col("delivery_days"), {"p50": 0.5, "p90": 0.9}, ["customer_id"])


@query("scan_csv_infer")
def _(spark, directory):
    path = staging.fresh_path(spark, "query-export-csv")
    sinks.write(mart.bi_export(staged_mart(spark, directory)), path, "csv")
    return replay.replay_aggregate(readers.scan_csv(spark, path))


@query("coerce_timestamps")
def _(spark, directory):
    orders = star.load_sources(spark, directory)["orders"]
    dated = [c for c in orders.columns if readers.is_timestamp_name(c)]
    text = orders.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("not known")) for c in dated})
    return readers.coerce_timestamps(text).select("order_id", *dated)


@query("require_sources")
def _(spark, directory):
    readers.require_sources(spark, [f"{directory}/{name}.parquet" for name in star.STAR_TABLES])
    return readers.raw_counts(star.read_star(spark, directory))


@query("register_raw")
def _(spark, directory):
    readers.register(star.load_sources(spark, directory))
    return spark.sql(
        "SELECT customer_state, count(*) AS orders FROM raw_orders LEFT JOIN raw_customers USING (customer_id)"
        " GROUP BY customer_state"
    )


@query("scan_parquet")
def _(spark, directory):
    path = staging.fresh_path(spark, "query-reviews-parquet")
    sinks.write(star.load_sources(spark, directory)["reviews"], path, "parquet")
    return readers.scan_parquet(spark, path)


@query("sink_csv")
def _(spark, directory):
    export = mart.bi_export(staged_mart(spark, directory))
    path = staging.fresh_path(spark, "query-export-csv")
    sinks.write(export, path, "csv")
    return readers.scan_csv(spark, path, export.schema)


@query("sink_parquet")
def _(spark, directory):
    path = staging.fresh_path(spark, "query-export-parquet")
    sinks.write(mart.bi_export(staged_mart(spark, directory)), path, "parquet")
    return readers.scan_parquet(spark, path)


@query("sink_parquet_by_month")
def _(spark, directory):
    export = mart.bi_export(staged_mart(spark, directory))
    path = staging.fresh_path(spark, "query-export-months")
    sinks.write_by_month(export, path)
    # Rebuilding the months of one year must replace them and leave the other months alone.
    sinks.write_by_month(export.filter(F.year("purchase_month") == 1996), path)
    months = readers.scan_parquet(spark, path).groupBy("purchase_ym")
    return months.agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("item_value_brl"), 2).alias("item_value_brl"))


@query("sink_parquet_by_state")
def _(spark, directory):
    path = staging.fresh_path(spark, "query-replay-states")
    replayed = replay.replay(mart.bi_export(staged_mart(spark, directory)), 3)
    sinks.write(replayed, path, "parquet", ["customer_state"])
    return replay.replay_aggregate(readers.scan_parquet(spark, path, replayed.schema))


@query("sink_json")
def _(spark, directory):
    summary = kpis.headline(staged_mart(spark, directory))
    path = staging.fresh_path(spark, "query-summary-json")
    sinks.write_json(summary.select(F.struct("*").alias("summary")), path)
    schema = T.StructType([T.StructField("summary", summary.schema)])
    return readers.scan_json(spark, path, schema).select("summary.*")


@query("scan_result_tables")
def _(spark, directory):
    segments_path, json_path = (staging.fresh_path(spark, n) for n in ("query-states-csv", "query-quality-json"))
    table = segments.segment_table(staged_mart(spark, directory), "customer_state")
    sinks.write(table, segments_path, "csv")
    sinks.write_json(contracts.ineligible_orders(staged_mart(spark, directory)), json_path)
    quality = readers.scan_json(spark, json_path, T.StructType([T.StructField("ineligible_orders", T.LongType())]))
    return readers.scan_csv(spark, segments_path, table.schema).withColumn("ineligible_orders", quality.scalar())


@query("source_manifest")
def _(spark, directory):
    return readers.source_manifest(spark, directory, "*.parquet")


_on_sources("raw_counts", readers.raw_counts)

# ---- contracts ---------------------------------------------------------------------------------------------


@query("check_dimension_key")
def _(spark, directory):
    tables = star.load_sources(spark, directory)
    # The last line is a real failure: orders may have several reviews.
    return contracts.source_contracts(tables).unionByName(
        contracts.check_key(tables["reviews"], "order_id", "raw_reviews")
    )


_on_sources("bad_keys", lambda t: contracts.bad_keys(t["reviews"], "order_id"))


@query("check_natural_key")
def _(spark, directory):
    return contracts.duplicate_keys(
        star.read_star(spark, directory, ["lineitem"])["lineitem"], ["l_orderkey", "l_linenumber"]
    )


def _with_sources(name: str, build: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]) -> None:
    query(name)(lambda spark, directory: build(staged_mart(spark, directory), star.load_sources(spark, directory)))


_with_sources("check_grain", lambda m, t: contracts.check_grain(m, t["orders"]))
_with_sources(
    "check_value_reconciliation", lambda m, t: contracts.check_sum(t["items"], "price", m, "item_value_brl")
)
_on_sources("check_score_domain", lambda t: contracts.check_domain(t["reviews"], "review_score", 1, 5))
_on_mart("ineligible_orders", contracts.ineligible_orders)
_on_mart("missing_review_eligible", contracts.missing_review_eligible)
_on_mart("pre_delivery_reviews", contracts.pre_delivery_reviews)
_on_mart("invalid_stage_eligible", contracts.invalid_stage_eligible)
_on_sources("extra_review_rows", lambda t: contracts.extra_review_rows(t["reviews"]))


_on_sources("items_missing_product", lambda t: contracts.items_missing_product(t["items"], t["products"]))
_on_sources("orders_missing_customer", lambda t: contracts.orders_missing_customer(t["orders"], t["customers"]))


def _items_as_text(spark: SparkSession, directory: str) -> DataFrame:
    """Items written as CSV, every thirteenth order's freight as no number, and read again."""
    items = star.load_sources(spark, directory)["items"]
    path = staging.fresh_path(spark, "query-items-text")
    broken = F.when(F.col("order_id") % 13 == 0, "free").otherwise(F.col("freight_value").cast("string"))
    sinks.write(items.withColumn("freight_value", broken), path, "csv")
    return readers.scan_csv(spark, path, items.schema, unread=contracts.UNREAD)


query("unread_values")(lambda spark, d: readers.unread_counts(_items_as_text(spark, d), contracts.UNREAD))


@query("quality_report")
def _(spark, directory):
    tables = star.load_sources(spark, directory)
    tables = {name: _items_as_text(spark, directory) if name == "items" else df for name, df in tables.items()}
    report = contracts.quality_report(staged_mart(spark, directory), tables)
    return report.select("raw_counts.*", *(c for c in report.columns if c != "raw_counts"))


# ---- mart --------------------------------------------------------------------------------------------------

_on_sources(
    "item_summary", lambda t: mart.item_summary(t["items"], t["products"], t["translation"], t["sellers"], t["orders"]).select(
        "order_id",
        "item_count",
        "seller_count",
        "item_value_brl",
        "freight_charged_brl",
        "category_count",
        "category",
        "mean_weight_g",
    )
)
_on_sources("first_review", lambda t: mart.first_review(t["reviews"]))


def _context(t: dict[str, DataFrame]) -> DataFrame:
    summary = mart.item_summary(t["items"], t["products"], t["translation"], t["sellers"], t["orders"])
    return mart.join_order_context(t["orders"], t["customers"], summary, mart.first_review(t["reviews"]))


_on_sources(
    "join_order_context",
    lambda t: _context(t).select(
        "order_id", "customer_id", "customer_state", "item_count", "category", "interstate", "review_score"
    ),
)
_on_sources(
    "durations",
    lambda t: mart.with_durations(t["orders"]).select(
        "order_id",
        "purchase_month",
        "promise_days",
        "lateness_days",
        "delivery_days",
        "handling_days",
        "transit_days",
    ),
)
_on_mart("eligibility", lambda m: m.select("order_id", "eligible"))
_on_mart("outcomes", lambda m: m.select("order_id", "on_time", "post_delivery_score", "poor_review"))
_on_mart("basket_band", lambda m: m.groupBy("basket_band").agg(F.count(F.lit(1)).alias("orders")))
_on_mart("valid_stages", lambda m: m.select("order_id", "valid_stages"))
_on_sources("mart_orders", mart.build_mart)
_on_mart(
    "eligible_orders", lambda m: mart.eligible_orders(m).select("order_id", "order_purchase_timestamp", "customer_id")
)
_on_mart("bi_export", mart.bi_export)

# ---- events ------------------------------------------------------------------------------------------------

_on_sources("delivery_events", lambda t: events.unpivot_events(t["orders"]))
_on_sources("event_intervals", lambda t: events.order_event_intervals(t["orders"]))


@query("event_intervals_long")
def _(spark, directory):
    long = events.unpivot_events(star.load_sources(spark, directory)["orders"])
    return events.event_intervals(long)


@query("event_intervals_users")
def _(spark, directory):
    stream = spark.read.parquet(f"{directory}/events.parquet")
    return events.event_intervals(stream, "user_id", "ts", "event_type", ties=["event_id"])


# ---- indicators --------------------------------------------------------------------------------------------

_on_mart("monthly_kpis", kpis.monthly_kpis)
_on_mart("state_priorities", kpis.state_priorities)
_on_mart("monthly_state_rank", lambda m: kpis.monthly_rank(m, min_n=3))
_on_mart("headline_summary", kpis.headline)
_on_mart("hidden_failure_headline", kpis.hidden_failure_headline)
_on_mart("review_sensitivity", kpis.review_sensitivity)
_on_mart("top_segments", lambda m: kpis.top_segments(segments.segment_table(m, "category", 30)))

# ---- statistics --------------------------------------------------------------------------------------------


@query("wilson")
def _(spark, directory):
    k, n = F.col("hidden"), F.col("reviewed")
    cells = staged_mart(spark, directory).groupBy("purchase_month", "customer_state")
    counts = cells.agg(kpis.on_time_reviewed().alias("reviewed"), kpis.hidden_failures().alias("hidden"))
    return counts.withColumns({"ci_low": wilson_low(k, n), "ci_high": wilson_high(k, n)})


_on_mart("segment_table_states", lambda m: segments.segment_table(m, "customer_state"))
_on_mart("segment_table_categories", lambda m: segments.segment_table(m, "category"))
_on_mart("segment_table_baskets", lambda m: segments.segment_table(m, "basket_band"))
_on_mart("weekly_cluster_counts", segments.weekly_cluster_counts)
_on_mart("cluster_bootstrap_gap", lambda m: resample.cluster_bootstrap_gap(segments.weekly_cluster_counts(m)))
_on_mart("direct_standardization", lambda m: segments.direct_standardization(m, min_n=MIN_STRATUM))
_on_mart("eta_scenarios", scenarios.eta_scenarios)
_on_mart(
    "cost_scenarios",
    # Four digits: prices have two, assumed margins one, so a sum of doubles cannot straddle a rounding edge.
    lambda m: scenarios.cost_scenarios(m).withColumn("proxy_contribution_brl", F.round("proxy_contribution_brl", 4)),
)
_on_mart("sample_size", lambda m: segments.experiment_sizes(segments.segment_table(m, "customer_state")))
_on_mart(
    "percentiles",
    lambda m: quantiles.exact_percentiles(
        mart.eligible_orders(m), F.col("delivery_days"), {"median": 0.5, "p90": 0.9}, ["customer_state"], few=True
    ),
)

# ---- delay model -------------------------------------------------------------------------------------------

_on_mart(
    "model_features", lambda m: features.model_features(m).select("order_id", *features.NUMERIC, "target")
)
query("temporal_splits")(lambda spark, d: _split_features(spark, d).select("order_id", "split"))


@query("check_splits")
def _(spark, directory):
    rows = _split_features(spark, directory)
    features.check_splits(rows)
    return features.split_sizes(rows)


query("train_medians")(lambda spark, d: features.medians(_split(spark, d, "train")))


@query("train_median_impute")
def _(spark, directory):
    filled = features.impute(_split_features(spark, directory), _split(spark, directory, "train"))
    return filled.select("order_id", "split", *features.NUMERIC, *features.CATEGORICAL)


@query("standardize")
def _(spark, directory):
    train = _split(spark, directory, "train")
    filled = features.impute(_split_features(spark, directory), train).select("order_id", "split", *features.NUMERIC)
    return features.standardize(filled, filled.filter("split = 'train'"))


query("onehot_min_frequency")(
    lambda spark, d: features.vocabulary(
        features.fill_missing(_split(spark, d, "train"), {}), MIN_FREQUENCY
    )
)

_models: dict[tuple[str, str], delay_model.DelayModel] = {}


def fitted_model(spark: SparkSession, directory: str) -> delay_model.DelayModel:
    key = (spark.sparkContext.applicationId, directory)
    if key not in _models:
        features.check_splits(_split_features(spark, directory))
        _models[key] = delay_model.fit(_split(spark, directory, "train"), min_frequency=MIN_FREQUENCY)
    return _models[key]


#: The mean gradient at the solver's stopping rule stays under this.
GRADIENT_TOLERANCE = 1e-3


@query("fit_logistic")
def _(spark, directory):
    gradients = delay_model.penalised_gradients(fitted_model(spark, directory), _split(spark, directory, "train"))
    return gradients.select("feature", (F.abs("gradient") < GRADIENT_TOLERANCE).alias("within_tolerance"))


# Fixed weights, so that scores can be compared without the solver: numbers in the order of features.NUMERIC, and
# categories by position.
FIXED_WEIGHTS = [-1.1, 0.7, 0.2, -0.3, 0.15, -0.25, 0.1, 0.4]
FIXED_STEP = {"customer_state": 0.03, "category": -0.05}
FIXED_INTERCEPT = -2.0


def fixed_model(spark: SparkSession, directory: str) -> delay_model.DelayModel:
    """Preprocessing fitted on the training split, weights as above."""
    model = delay_model.fit_preprocessing(_split(spark, directory, "train"), MIN_FREQUENCY)
    by_place = [FIXED_STEP[c] * (place + 1) for c in features.CATEGORICAL for place in range(len(model.labels[c]))]
    model.weights, model.intercept = [*FIXED_WEIGHTS, *by_place], FIXED_INTERCEPT
    return model


def _on_model(name: str, model_of: Callable[[SparkSession, str], delay_model.DelayModel]) -> None:
    """The queries of a model, under names that end in ``name``."""

    def scored(spark: SparkSession, directory: str, *splits: str) -> list[DataFrame]:
        model = model_of(spark, directory)
        return [delay_model.score(model, _split(spark, directory, s)) for s in splits]

    query(f"score{name}")(lambda spark, d: scored(spark, d, "validation")[0].select("order_id", "target", "probability"))
    query(f"coefficients{name}")(lambda spark, d: delay_model.coefficients(model_of(spark, d), staged_mart(spark, d)))

    @query(f"predictions{name}")
    def _(spark, directory):
        validation, test = scored(spark, directory, "validation", "test")
        return delay_model.predictions(test, delay_model.chosen_threshold(validation).select("threshold").scalar())

    @query(f"model_report{name}")
    def _(spark, directory):
        validation, test = (
            staging.stage(rows.select("target", "probability"), "scored")
            for rows in scored(spark, directory, "validation", "test")
        )
        return delay_model.model_report(_split(spark, directory, "train"), validation, test)


_on_model("", fitted_model)
_on_model("_fixed_weights", fixed_model)


# ---- score evaluation --------------------------------------------------------------------------------------


def _on_scores(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, directory: build(scored_orders(spark, directory)))


_on_scores(
    "error_cost",
    lambda s: s.groupBy("split").agg(
        F.sum(error_cost(F.col("label"), F.col("score") >= 0.1)).alias("assumed_error_cost_brl")
    ),
)
_on_scores("threshold_sweep", lambda s: scoring.threshold_sweep(s, "label", "score"))
_on_scores("best_threshold", lambda s: scoring.best_threshold(scoring.threshold_sweep(s, "label", "score")))
_on_scores(
    "constant_baseline",
    lambda s: scoring.constant_baseline(
        *(s.filter(F.col("split") == name) for name in features.SPLITS), "label"
    ),
)
_on_scores("roc_auc", lambda s: scoring.roc_auc(s, "label", "score"))
_on_scores("roc_auc_small_cells", lambda s: scoring.roc_auc(s, "label", "score", cell_rows=100))


def _skewed_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Prices to the fourth power: most scores stand in a small part of their range."""
    x = F.col("l_extendedprice").cast("double") / F.lit(100_000.0)
    lines = star.read_star(spark, directory, ["lineitem"])["lineitem"]
    return lines.select((F.col("l_returnflag") == "R").cast("int").alias("label"), (x * x * x * x / F.lit(20.0)).alias("score"))


query("roc_auc_skewed")(lambda spark, d: scoring.roc_auc(_skewed_scores(spark, d), "label", "score", cell_rows=500))
query("average_precision_skewed")(lambda spark, d: scoring.average_precision(_skewed_scores(spark, d), "label", "score", cell_rows=500))
_on_scores("average_precision", lambda s: scoring.average_precision(s, "label", "score"))
_on_scores("brier", lambda s: scoring.brier(s, "label", "score"))
_on_scores("alert_metrics", lambda s: scoring.alert_metrics(s, "label", F.col("score") >= 0.1))
_on_scores("calibration_quantile", lambda s: scoring.calibration(s, "label", "score"))
_on_scores(
    "score_report",
    lambda s: scoring.evaluate(s.filter("split = 'test'"), "label", "score", F.col("score") >= 0.1, "deadline_score"),
)

# ---- replay ------------------------------------------------------------------------------------------------

_on_mart(
    "replay",
    lambda m: replay.replay(mart.bi_export(m), 20)
    .groupBy("replay_id")
    .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("item_value_brl"), 2).alias("item_value_brl")),
)
_on_mart("replay_aggregate", lambda m: replay.replay_aggregate(replay.replay(mart.bi_export(m), 20)))
_on_mart(
    "replay_check",
    lambda m: replay.replay_check(mart.bi_export(m), replay.replay(mart.bi_export(m), 20)),
)

# ---- per-state views ---------------------------------------------------------------------------------------

_on_mart("view_cards", views.view_cards)
_on_mart("view_monthly", views.view_monthly)
_on_mart("view_top_categories", lambda m: views.view_top_categories(m, min_n=5))
_on_mart("view_lateness_bands", views.view_lateness_bands)
