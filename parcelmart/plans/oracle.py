"""The same results as plain SQL over the star-schema tables, for an independent engine.

Each entry is a WITH prefix (source tables, then the mart) and a final SELECT. ``_plain`` applies the column types of
``registry.portable``: whole numbers as BIGINT, doubles rounded to six digits, dates as text.
"""

from __future__ import annotations

SOURCES = """
raw_customers AS (
  SELECT c_custkey AS customer_id, n_name AS customer_state FROM customer JOIN nation ON c_nationkey = n_nationkey
), raw_sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey
), raw_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_type END AS product_category_name,
         CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_size * 100 END AS product_weight_g
  FROM part
), raw_translation AS (
  SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
  FROM part WHERE p_type <> 'PROMO'
), raw_items AS (
  SELECT l_orderkey AS order_id,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS order_item_id,
         l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice AS price,
         floor(l_extendedprice * l_tax * 100) / CAST(100 AS DOUBLE) AS freight_value
  FROM lineitem
), order_clock AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderdate AS order_day,
         o_orderdate + ((o_orderkey * 37) % 1440) * INTERVAL '1' MINUTE AS purchased,
         (o_orderkey * 13) % 2880 AS approve_min,
         (o_orderkey * 13) % 2880 + (o_orderkey * 101) % 7200 - 240 AS carrier_min,
         (o_orderkey * 211) % 28800 AS transit_min
  FROM orders
), raw_orders AS (
  SELECT k AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'P' AND k % 4 = 0 THEN 'canceled' ELSE 'delivered' END AS order_status,
         purchased AS order_purchase_timestamp,
         CASE WHEN k % 97 <> 0 THEN purchased + approve_min * INTERVAL '1' MINUTE END AS order_approved_at,
         CASE WHEN k % 89 <> 0 THEN purchased + carrier_min * INTERVAL '1' MINUTE END AS order_delivered_carrier_date,
         CASE WHEN (o_orderstatus = 'P' AND k % 4 = 0) OR k % 101 = 0 THEN NULL
              WHEN k % 113 = 0 THEN purchased - INTERVAL '1' DAY
              ELSE purchased + (carrier_min + transit_min + 240) * INTERVAL '1' MINUTE
         END AS order_delivered_customer_date,
         order_day + (CASE WHEN k % 127 = 0 THEN -1 ELSE 12 + (k * 7) % 15 END) * INTERVAL '1' DAY
           AS order_estimated_delivery_date
  FROM order_clock
), raw_reviews AS (
  SELECT 'a' || CAST(k AS VARCHAR) AS review_id, k AS order_id, CAST(1 + (k * 17 + k % 7) % 5 AS INT) AS review_score,
         purchased + (carrier_min + transit_min + 240) * INTERVAL '1' MINUTE AS review_creation_date,
         CASE WHEN k % 53 <> 0 THEN
           purchased + (carrier_min + transit_min + 240 + (k * 53) % 10080 - 1440) * INTERVAL '1' MINUTE
         END AS review_answer_timestamp
  FROM order_clock WHERE k % 20 <> 0
  UNION ALL
  SELECT 'b' || CAST(k AS VARCHAR), k, CAST(1 + k % 5 AS INT),
         purchased + (carrier_min + transit_min + 240) * INTERVAL '1' MINUTE,
         purchased + (carrier_min + transit_min + 240 + (k * 53) % 10080 - 1440 + (k % 3 - 1) * 600) * INTERVAL '1' MINUTE
  FROM order_clock WHERE k % 11 = 0
)"""

MART = """
item_lines AS (
  SELECT raw_items.*, product_category_name, product_category_name_english, product_weight_g, seller_state
  FROM raw_items
  LEFT JOIN raw_products ON raw_products.product_id = raw_items.product_id
  LEFT JOIN raw_translation USING (product_category_name)
  LEFT JOIN raw_sellers ON raw_sellers.seller_id = raw_items.seller_id
), baskets AS (
  SELECT order_id, count(*) AS item_count, count(DISTINCT seller_id) AS seller_count,
         sum(price) AS item_value_brl, sum(freight_value) AS freight_charged_brl,
         count(DISTINCT product_category_name) AS category_count,
         if(count(DISTINCT product_category_name) > 1, 'mixed_categories',
            coalesce(any_value(product_category_name_english), 'unknown')) AS category,
         avg(product_weight_g) AS mean_weight_g,
         list(DISTINCT seller_state) FILTER (WHERE seller_state IS NOT NULL) AS seller_states
  FROM item_lines GROUP BY order_id
), chosen_reviews AS (
  SELECT DISTINCT ON (order_id) order_id, review_score, review_answer_timestamp, review_creation_date
  FROM raw_reviews WHERE review_answer_timestamp IS NOT NULL AND review_score >= 1 AND review_score <= 5
  ORDER BY order_id, review_answer_timestamp, review_id NULLS LAST, review_score, review_creation_date NULLS LAST
), context AS (
  SELECT o.*, customer_state, item_count, seller_count, item_value_brl, freight_charged_brl, category_count, category,
         mean_weight_g,
         CASE WHEN item_count IS NULL THEN NULL
              ELSE coalesce(len(list_filter(seller_states, lambda s: s <> customer_state)) > 0, false)::INT
         END AS interstate,
         review_score, review_answer_timestamp, review_creation_date
  FROM raw_orders o
  LEFT JOIN raw_customers cu ON cu.customer_id = o.customer_id
  LEFT JOIN baskets ba ON ba.order_id = o.order_id
  LEFT JOIN chosen_reviews re ON re.order_id = o.order_id
), timed AS (
  SELECT *, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month,
         CAST(order_estimated_delivery_date AS DATE) - CAST(order_purchase_timestamp AS DATE) AS promise_days,
         CAST(order_delivered_customer_date AS DATE) - CAST(order_estimated_delivery_date AS DATE) AS lateness_days,
         (epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 1e6 / 86400 AS delivery_days,
         (epoch_us(order_delivered_carrier_date) - epoch_us(order_approved_at)) / 1e6 / 86400 AS handling_days,
         (epoch_us(order_delivered_customer_date) - epoch_us(order_delivered_carrier_date)) / 1e6 / 86400 AS transit_days
  FROM context
), flagged AS (
  SELECT *, order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL
            AND order_estimated_delivery_date >= date_trunc('day', order_purchase_timestamp)
            AND order_delivered_customer_date >= order_purchase_timestamp AND item_count > 0 AS eligible
  FROM timed
), mart AS (
  SELECT *, if(eligible, lateness_days <= 0, NULL) AS on_time,
         if(eligible AND review_answer_timestamp >= order_delivered_customer_date, review_score, NULL)
           AS post_delivery_score,
         if(eligible AND review_answer_timestamp >= order_delivered_customer_date, review_score < 3, NULL)
           AS poor_review,
         if(item_count IS NULL, 'unknown', if(item_count = 1, '1 item', '2+ items')) AS basket_band,
         coalesce(least(handling_days, transit_days) >= 0 AND handling_days IS NOT NULL AND transit_days IS NOT NULL,
                  false) AS valid_stages
  FROM flagged
), good AS (
  SELECT * FROM mart WHERE eligible
), punctual AS (
  SELECT * FROM good WHERE on_time AND poor_review IS NOT NULL
)"""

FEATURES = """
features AS (
  SELECT *, (epoch_us(date_trunc('day', order_estimated_delivery_date)) + 86400000000
             - epoch_us(order_delivered_carrier_date)) / 1e6 / 86400 AS promise_remaining_days,
         ln(1 + item_value_brl) AS log_item_value, if(on_time, 0, 1) AS target
  FROM good WHERE valid_stages AND order_delivered_carrier_date IS NOT NULL
), splits AS (
  SELECT *, CASE
    WHEN order_delivered_carrier_date < '2000-01-01' THEN
      if(order_delivered_customer_date < '2000-01-01', 'train', NULL)
    WHEN order_delivered_carrier_date < '2000-10-01' THEN
      if(order_delivered_customer_date < '2000-10-01', 'validation', NULL)
    WHEN order_delivered_carrier_date < '2001-07-01' THEN
      if(order_delivered_customer_date < '2001-08-01', 'test', NULL) END AS split
  FROM features
), matured AS (
  SELECT * FROM splits WHERE split IS NOT NULL
), scored AS (
  SELECT order_id, split, target AS label, 1.0::DOUBLE / (1.0 + greatest(promise_remaining_days, 0.0)) AS score FROM matured
)"""

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

FILLED = (
    "medians AS (SELECT "
    + ", ".join(f"quantile_cont({c}::DOUBLE, 0.5) AS {c}" for c in NUMERIC)
    + " FROM matured WHERE split = 'train'), filled AS (SELECT order_id, split, target, "
    + ", ".join(f"coalesce(matured.{c}::DOUBLE, medians.{c}) AS {c}" for c in NUMERIC)
    + ", coalesce(customer_state, 'unknown') AS customer_state, coalesce(category, 'unknown') AS category"
    " FROM matured, medians)"
)

VOCABULARY = """
vocabulary AS (
  SELECT feature, value, n, if(n < 300, 'infrequent', value) AS label,
         if(n < 300, sum((n >= 300)::INT) OVER (PARTITION BY feature),
            row_number() OVER (PARTITION BY feature ORDER BY n < 300, value) - 1) AS place
  FROM (SELECT 'customer_state' AS feature, customer_state AS value, count(*) AS n FROM filled WHERE split = 'train' GROUP BY 2
        UNION ALL SELECT 'category', category, count(*) FROM filled WHERE split = 'train' GROUP BY 2)
)"""

# Weights of the registered fixed model, in the order of NUMERIC and by position.
_WEIGHTS = dict(zip(NUMERIC, ["-1.1", "0.7", "0.2", "-0.3", "0.15", "-0.25", "0.1", "0.4"]))
FIXED_SCORES = (
    "spread AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + " FROM filled WHERE split = 'train'), margins AS (SELECT filled.order_id, filled.split, target, -2.0::DOUBLE + "
    + " + ".join(f"{w}::DOUBLE * (filled.{c} - m_{c}) / if(s_{c} = 0, 1, s_{c})" for c, w in _WEIGHTS.items())
    + """ + coalesce(0.03::DOUBLE * (s.place + 1), 0) + coalesce(-0.05::DOUBLE * (g.place + 1), 0) AS margin
  FROM filled CROSS JOIN spread
  LEFT JOIN vocabulary s ON s.feature = 'customer_state' AND s.value = filled.customer_state
  LEFT JOIN vocabulary g ON g.feature = 'category' AND g.value = filled.category
), fixed AS (
  SELECT order_id, split, target AS label, 1 / (1 + exp(-margin)) AS score FROM margins
)"""
)
# The threshold of least cost on the validation split.
CHOSEN = """
chosen AS (
  SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold
  FROM range(99) AS steps(i), (SELECT score, label FROM fixed WHERE split = 'validation')
  GROUP BY i
  ORDER BY sum(CASE WHEN score >= 0.01::DOUBLE + i * 0.01::DOUBLE AND label = 0 THEN 3
                    WHEN score < 0.01::DOUBLE + i * 0.01::DOUBLE AND label = 1 THEN 25 ELSE 0 END), i
  LIMIT 1
)"""


def _wilson(k: str, n: str) -> str:
    z = "1.959963984540054"
    centre = f"({k} / {n}::DOUBLE + {z} * {z} / (2 * {n}))"
    radius = f"({z} * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {z} * {z} / (4.0 * {n} * {n})))"
    scale = f"(1 + {z} * {z} / {n})"
    return (
        f"CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0.0::DOUBLE"
        f" ELSE greatest(0.0, ({centre} - {radius}) / {scale}) END AS ci_low,"
        f" CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1.0::DOUBLE"
        f" ELSE least(1.0, ({centre} + {radius}) / {scale}) END AS ci_high"
    )


def _plain(spec: str, body: str, *prefix: str) -> str:
    """``spec`` lists output columns as name:kind with kind i(nteger), n(ullable integer), d(ouble) or s(tring)."""
    casts = {
        "i": "CAST({c} AS BIGINT) AS {c}",
        "n": "CAST({c} AS DOUBLE) AS {c}",
        "d": "round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}",
        "s": "CAST({c} AS VARCHAR) AS {c}",
    }
    columns = (item.split(":") for item in spec.split())
    select = ", ".join(casts[kind].format(c=f'"{name}"') for name, kind in columns)
    parts = ", ".join(part.strip() for part in prefix)
    return f"{'WITH ' + parts if parts else ''} SELECT {select} FROM ({body}) AS result"


def _source(spec: str, body: str) -> str:
    return _plain(spec, body, SOURCES)


def _mart(spec: str, body: str, *more: str) -> str:
    return _plain(spec, body, SOURCES, MART, *more)


def _model(spec: str, body: str, *more: str) -> str:
    return _plain(spec, body, SOURCES, MART, FEATURES, *more)


_EXPORT = (
    "order_id:i purchase_month:s customer_state:s category:s basket_band:s item_count:n item_value_brl:d"
    " freight_charged_brl:d promise_days:i lateness_days:n delivery_days:d handling_days:d transit_days:d"
    " valid_stages:i on_time:n post_delivery_score:n poor_review:n"
)
_SEGMENT = "segment:s reviewed_on_time:i hidden_failures:i rate:d ci_low:d ci_high:d"
_STATE_REPLAY = "customer_state:s n:i on_time_n:i"


def _segments(column: str, min_n: int, rows: str = "punctual") -> str:
    return (
        f"SELECT segment, n AS reviewed_on_time, k AS hidden_failures, k / n::DOUBLE AS rate, {_wilson('k', 'n')} FROM"
        f" (SELECT {column}::VARCHAR AS segment, count(*) AS n, count(*) FILTER (WHERE poor_review) AS k FROM {rows}"
        f" WHERE {column} IS NOT NULL GROUP BY 1) WHERE n >= {min_n}"
    )


def _replayed(times: int) -> str:
    return (
        f"SELECT customer_state, count(*) AS n, count(*) FILTER (WHERE on_time) AS on_time_n"
        f" FROM good, range({times}) GROUP BY 1"
    )


_COUNTS = {
    "orders": "raw_orders",
    "items": "raw_items",
    "reviews": "raw_reviews",
    "customers": "raw_customers",
    "products": "raw_products",
    "sellers": "raw_sellers",
    "translation": "raw_translation",
}

_HEADLINE_SPEC = (
    "eligible_orders:i purchase_min:s purchase_max:s on_time_orders:i on_time_rate:d reviewed_orders:i"
    " review_coverage:d reviewed_on_time:i hidden_failure_orders:i hidden_failure_rate:d hidden_failure_ci_low:d"
    " hidden_failure_ci_high:d poor_review_rate_late:d p90_delivery_days:d"
)
_HEADLINE = (
    "SELECT * EXCLUDE (ci_low, ci_high), ci_low AS hidden_failure_ci_low, ci_high AS hidden_failure_ci_high FROM (SELECT *, "
    + _wilson("hidden_failure_orders", "reviewed_on_time")
    + """ FROM (
  SELECT count(*) AS eligible_orders, min(order_purchase_timestamp) AS purchase_min,
         max(order_purchase_timestamp) AS purchase_max, count(*) FILTER (WHERE on_time) AS on_time_orders,
         avg(on_time::INT) AS on_time_rate, count(poor_review) AS reviewed_orders,
         count(poor_review) / count(*)::DOUBLE AS review_coverage,
         count(poor_review) FILTER (WHERE on_time) AS reviewed_on_time,
         count(*) FILTER (WHERE on_time AND poor_review) AS hidden_failure_orders,
         avg(poor_review::INT) FILTER (WHERE on_time) AS hidden_failure_rate,
         avg(poor_review::INT) FILTER (WHERE NOT on_time) AS poor_review_rate_late,
         quantile_cont(delivery_days, 0.9) AS p90_delivery_days
  FROM good))"""
)

_INTERVALS = """
SELECT *, lag(event_type) OVER w AS previous_event,
       (epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 1e6 / 3600 AS hours_since_previous
FROM (
  SELECT order_id, unnest(['purchase', 'approved', 'carrier_handoff', 'delivered']) AS event_type,
         unnest([order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
                 order_delivered_customer_date]) AS event_time
  FROM raw_orders
) WHERE event_time IS NOT NULL OR event_type = 'purchase'
WINDOW w AS (PARTITION BY order_id ORDER BY event_time NULLS LAST, event_type)"""
_INTERVAL_SPEC = "order_id:i event_type:s event_time:s previous_event:s hours_since_previous:d"

_WEEKS = """
weeks AS (
  SELECT date_trunc('week', order_purchase_timestamp)::DATE AS week,
         count(*) FILTER (WHERE poor_review AND NOT on_time) AS late_poor, count(*) FILTER (WHERE NOT on_time) AS late_n,
         count(*) FILTER (WHERE poor_review AND on_time) AS on_time_poor, count(*) FILTER (WHERE on_time) AS on_time_n
  FROM good WHERE poor_review IS NOT NULL GROUP BY 1
)"""

_VIEWS = """
state_views AS (
  SELECT 'All states' AS state_view, good.* FROM good
  UNION ALL SELECT customer_state, good.* FROM good WHERE customer_state IS NOT NULL
)"""

# Running counts over all distinct scores, the plain way.
_CURVE = """
score_counts AS (
  SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM {rows} GROUP BY score
), curve AS (
  SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM score_counts
)"""
_SKEWED = """
skewed AS (
  SELECT (l_returnflag = 'R')::INT AS label, x * x * x * x / 20::DOUBLE AS score
  FROM (SELECT l_returnflag, l_extendedprice::DOUBLE / 100000::DOUBLE AS x FROM lineitem)
)"""
_AUC = "sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE"
_AP = "sum(pos * (tp / (tp + fp)::DOUBLE)) / sum(pos)"
_BRIER = "sum(pos * (1 - score) * (1 - score) + neg * score * score) / sum(pos + neg)"
_SWEEP = """
sweep AS (
  SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold,
         (SELECT sum(CASE WHEN score >= 0.01::DOUBLE + i * 0.01::DOUBLE AND label = 0 THEN 3.0
                          WHEN score < 0.01::DOUBLE + i * 0.01::DOUBLE AND label = 1 THEN 25.0 ELSE 0.0 END)
          FROM scored) AS validation_assumed_error_cost
  FROM range(99) AS steps(i)
)"""
_MODEL_SPEC = (
    "model:s roc_auc:d average_precision:d brier_score:d assumed_error_cost_brl:d alerts:i precision:d recall:d"
)
CONSTANT = """
constant AS (
  SELECT label, (SELECT avg(label) FROM scored WHERE split = 'train') AS score,
         (SELECT 3 * sum(1 - label) < 25 * sum(label) FROM scored WHERE split = 'validation') AS alert_all
  FROM scored WHERE split = 'test'
)"""


def _metrics(model: str, rows: str, alert: str) -> str:
    return f"""
SELECT '{model}' AS model, {_AUC} AS roc_auc, {_AP} AS average_precision, {_BRIER} AS brier_score,
       any_value(cost) AS assumed_error_cost_brl, any_value(alerts) AS alerts,
       any_value(hits / nullif(alerts, 0)::DOUBLE) AS precision, any_value(hits / positives::DOUBLE) AS recall
FROM curve, (
  SELECT sum(CASE WHEN ({alert}) AND label = 0 THEN 3.0 WHEN NOT ({alert}) AND label = 1 THEN 25.0 ELSE 0.0 END) AS cost,
         count(*) FILTER (WHERE {alert}) AS alerts, count(*) FILTER (WHERE ({alert}) AND label = 1) AS hits,
         count(*) FILTER (WHERE label = 1) AS positives
  FROM {rows})"""


_QUALITY = """
SELECT {counts},
       (SELECT count(*) = count(DISTINCT order_id) AND count(*) = (SELECT count(*) FROM raw_orders) FROM mart)
         AS order_grain_pass,
       abs(gap) < 0.01 AS item_value_reconciled, gap AS item_value_difference_brl,
       (SELECT count(*) FROM mart) - (SELECT count(*) FROM good) AS ineligible_orders,
       (SELECT count(*) FROM good WHERE review_score IS NULL) AS missing_review_eligible,
       (SELECT count(*) FROM good WHERE review_answer_timestamp < order_delivered_customer_date) AS pre_delivery_reviews,
       (SELECT count(*) FROM good WHERE NOT valid_stages) AS invalid_stage_eligible,
       (SELECT count(*) - count(DISTINCT order_id) FROM raw_reviews) AS extra_review_rows,
       (SELECT count(*) FROM raw_items WHERE product_id NOT IN (SELECT product_id FROM raw_products))
         AS items_missing_product,
       (SELECT count(*) FROM raw_orders WHERE customer_id NOT IN (SELECT customer_id FROM raw_customers))
         AS orders_missing_customer,
       (SELECT count(*) FROM raw_items WHERE order_id % 13 = 0) AS unread_values
FROM (SELECT (SELECT sum(price::DECIMAL(28,6)) FROM raw_items) - (SELECT sum(item_value_brl::DECIMAL(28,6)) FROM mart)
      AS gap)""".format(counts=", ".join(f"(SELECT count(*) FROM {t}) AS {n}" for n, t in _COUNTS.items()))

_CHECK = "check_name:s passed:i detail:d"


def _key_check(table: str, key: str) -> str:
    return (
        f"SELECT '{table}:{key}' AS check_name, count(*) = count(DISTINCT {key}) AS passed,"
        f" count(*) - count(DISTINCT {key}) AS detail FROM {table}"
    )


_KEY_CHECKS = " UNION ALL ".join(
    [
        _key_check("raw_orders", "order_id"),
        _key_check("raw_customers", "customer_id"),
        _key_check("raw_products", "product_id"),
        _key_check("raw_sellers", "seller_id"),
        _key_check("raw_translation", "product_category_name"),
        _key_check("raw_reviews", "order_id"),
        "SELECT 'raw_items:order_id+order_item_id', count(*) = 0, count(*) FROM"
        " (SELECT order_id, order_item_id FROM raw_items GROUP BY ALL HAVING count(*) > 1)",
    ]
)

_MART_SPEC = (
    "order_id:i customer_id:i order_status:s order_purchase_timestamp:s order_approved_at:s"
    " order_delivered_carrier_date:s order_delivered_customer_date:s order_estimated_delivery_date:s customer_state:s"
    " item_count:n seller_count:n item_value_brl:d freight_charged_brl:d category_count:n category:s mean_weight_g:d"
    " interstate:n review_score:n review_answer_timestamp:s review_creation_date:s purchase_month:s promise_days:i"
    " lateness_days:n delivery_days:d handling_days:d transit_days:d eligible:n on_time:n post_delivery_score:n"
    " poor_review:n basket_band:s valid_stages:i"
)

ORACLE: dict[str, str] = {
    # sources and sinks
    "scan_csv": _source(
        "order_id:i order_item_id:i product_id:i seller_id:i price:d freight_value:d", "SELECT * FROM raw_items"
    ),
    "scan_csv_mixed_headers": _source(
        "order_id:i order_item_id:i product_id:i seller_id:i price:d freight_value:d", "SELECT * FROM raw_items"
    ),
    "percentiles_by_customer": _mart(
        "customer_id:i p50:d p90:d",
        "SELECT customer_id, quantile_cont(delivery_days, 0.5) AS p50, quantile_cont(delivery_days, 0.9) AS p90 FROM mart"
        " WHERE customer_id IS NOT NULL AND delivery_days IS NOT NULL GROUP BY 1",
    ),
    "scan_csv_infer": _mart(_STATE_REPLAY, _replayed(1)),
    "coerce_timestamps": _source(
        "order_id:i order_purchase_timestamp:s order_approved_at:s order_delivered_carrier_date:s"
        " order_delivered_customer_date:s order_estimated_delivery_date:s",
        "SELECT * FROM raw_orders",
    ),
    "require_sources": _plain(
        "table_name:s n:i",
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}"
            for t in ("nation", "customer", "supplier", "part", "orders", "lineitem")
        ),
    ),
    "register_raw": _source(
        "customer_state:s orders:i",
        "SELECT customer_state, count(*) AS orders FROM raw_orders LEFT JOIN raw_customers USING (customer_id) GROUP BY 1",
    ),
    "scan_parquet": _source(
        "review_id:s order_id:i review_score:n review_creation_date:s review_answer_timestamp:s",
        "SELECT * FROM raw_reviews",
    ),
    "sink_csv": _mart(_EXPORT, "SELECT * FROM good"),
    "sink_parquet": _mart(_EXPORT, "SELECT * FROM good"),
    "sink_parquet_by_month": _mart(
        "purchase_ym:s orders:i item_value_brl:d",
        "SELECT strftime(purchase_month, '%Y-%m') AS purchase_ym, count(*) AS orders, round(sum(item_value_brl), 2) AS item_value_brl"
        " FROM good GROUP BY 1",
    ),
    "sink_parquet_by_state": _mart(_STATE_REPLAY, _replayed(3)),
    "sink_json": _mart(_HEADLINE_SPEC, _HEADLINE),
    "scan_result_tables": _mart(
        _SEGMENT + " ineligible_orders:i",
        f"SELECT *, (SELECT count(*) FROM mart WHERE eligible IS NOT TRUE) AS ineligible_orders"
        f" FROM ({_segments('customer_state', 100)})",
    ),
    "raw_counts": _source(
        "table_name:s n:i",
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {t}" for n, t in _COUNTS.items()),
    ),
    # contracts
    "check_dimension_key": _source(_CHECK, _KEY_CHECKS),
    "bad_keys": _source(
        "order_id:i n:i", "SELECT order_id, count(*) AS n FROM raw_reviews GROUP BY 1 HAVING count(*) > 1"
    ),
    "check_natural_key": _plain(
        "l_orderkey:i l_linenumber:i n:i",
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "check_grain": _mart(
        _CHECK,
        "SELECT 'mart_grain' AS check_name, count(*) = count(DISTINCT order_id) AND count(*) = s AS passed,"
        " count(*) - s AS detail FROM mart, (SELECT count(*) AS s FROM raw_orders) GROUP BY s",
    ),
    "check_value_reconciliation": _mart(
        _CHECK,
        "SELECT 'value_reconciliation' AS check_name, abs(a - b) < 0.01 AS passed, a - b AS detail FROM"
        " (SELECT sum(price::DECIMAL(28,6)) AS a FROM raw_items),"
        " (SELECT sum(item_value_brl::DECIMAL(28,6)) AS b FROM mart)",
    ),
    "check_score_domain": _source(
        _CHECK,
        "SELECT 'domain:review_score' AS check_name, count(*) = 0 AS passed, count(*) AS detail FROM raw_reviews"
        " WHERE review_score < 1 OR review_score > 5",
    ),
    "ineligible_orders": _mart(
        "ineligible_orders:i", "SELECT count(*) AS ineligible_orders FROM mart WHERE eligible IS NOT TRUE"
    ),
    "missing_review_eligible": _mart(
        "missing_review_eligible:i", "SELECT count(*) AS missing_review_eligible FROM good WHERE review_score IS NULL"
    ),
    "pre_delivery_reviews": _mart(
        "pre_delivery_reviews:i",
        "SELECT count(*) AS pre_delivery_reviews FROM good"
        " WHERE order_delivered_customer_date > review_answer_timestamp",
    ),
    "invalid_stage_eligible": _mart(
        "invalid_stage_eligible:i", "SELECT count(*) AS invalid_stage_eligible FROM good WHERE NOT valid_stages"
    ),
    "extra_review_rows": _source(
        "extra_review_rows:i", "SELECT count(*) - count(DISTINCT order_id) AS extra_review_rows FROM raw_reviews"
    ),
    "items_missing_product": _source(
        "items_missing_product:i",
        "SELECT count(*) AS items_missing_product FROM raw_items ANTI JOIN raw_products USING (product_id)",
    ),
    "orders_missing_customer": _source(
        "orders_missing_customer:i",
        "SELECT count(*) AS orders_missing_customer FROM raw_orders ANTI JOIN raw_customers USING (customer_id)",
    ),
    "quality_report": _mart(
        " ".join(f"{n}:i" for n in _COUNTS)
        + " order_grain_pass:i item_value_reconciled:i item_value_difference_brl:d ineligible_orders:i"
        " missing_review_eligible:i pre_delivery_reviews:i invalid_stage_eligible:i extra_review_rows:i"
        " items_missing_product:i orders_missing_customer:i unread_values:i",
        _QUALITY,
    ),
    "unread_values": _source(
        "column:s n:i", "SELECT 'freight_value' AS \"column\", count(*) AS n FROM raw_items WHERE order_id % 13 = 0"
    ),
    # mart
    "item_summary": _mart(
        "order_id:i item_count:n seller_count:n item_value_brl:d freight_charged_brl:d category_count:n category:s"
        " mean_weight_g:d",
        "SELECT * FROM baskets",
    ),
    "first_review": _mart(
        "order_id:i review_score:n review_answer_timestamp:s review_creation_date:s", "SELECT * FROM chosen_reviews"
    ),
    "join_order_context": _mart(
        "order_id:i customer_id:i customer_state:s item_count:n category:s interstate:n review_score:n",
        "SELECT * FROM context",
    ),
    "durations": _mart(
        "order_id:i purchase_month:s promise_days:i lateness_days:n delivery_days:d handling_days:d transit_days:d",
        "SELECT * FROM timed",
    ),
    "eligibility": _mart("order_id:i eligible:n", "SELECT * FROM mart"),
    "outcomes": _mart("order_id:i on_time:n post_delivery_score:n poor_review:n", "SELECT * FROM mart"),
    "basket_band": _mart(
        "basket_band:s orders:i", "SELECT basket_band, count(*) AS orders FROM mart GROUP BY basket_band"
    ),
    "valid_stages": _mart("order_id:i valid_stages:i", "SELECT * FROM mart"),
    "mart_orders": _mart(_MART_SPEC, "SELECT * FROM mart"),
    "eligible_orders": _mart("order_id:i order_purchase_timestamp:s customer_id:i", "SELECT * FROM good"),
    "bi_export": _mart(_EXPORT, "SELECT * FROM good"),
    # events
    "delivery_events": _source("order_id:i event_type:s event_time:s", _INTERVALS),
    "event_intervals": _source(_INTERVAL_SPEC, _INTERVALS),
    "event_intervals_long": _source(_INTERVAL_SPEC, _INTERVALS),
    "event_intervals_users": _plain(
        "event_id:i user_id:i event_type:s ts:s value:d props:s previous_event:s hours_since_previous:d",
        "SELECT *, lag(event_type) OVER w AS previous_event,"
        " (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / 3600 AS hours_since_previous FROM events"
        " WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS LAST, event_type NULLS LAST, event_id)",
    ),
    # indicators
    "monthly_kpis": _mart(
        "purchase_month:s orders:i on_time_orders:i late_orders:i reviewed_orders:i reviewed_on_time:i"
        " hidden_failure_orders:i on_time_rate:d hidden_failure_rate:d p90_delivery_days:d",
        """SELECT purchase_month, count(*) AS orders, count(*) FILTER (WHERE on_time) AS on_time_orders,
                  count(*) FILTER (WHERE NOT on_time) AS late_orders, count(poor_review) AS reviewed_orders,
                  count(poor_review) FILTER (WHERE on_time) AS reviewed_on_time,
                  count(*) FILTER (WHERE on_time AND poor_review) AS hidden_failure_orders,
                  avg(on_time::INT) AS on_time_rate, avg(poor_review::INT) FILTER (WHERE on_time) AS hidden_failure_rate,
                  quantile_cont(delivery_days, 0.9) AS p90_delivery_days
           FROM good GROUP BY purchase_month""",
    ),
    "state_priorities": _mart(
        "customer_state:s eligible_orders:i reviewed_on_time:i hidden_failures:i hidden_failure_rate:d",
        """SELECT customer_state, count(*) AS eligible_orders, count(poor_review) FILTER (WHERE on_time) AS reviewed_on_time,
                  count(*) FILTER (WHERE poor_review AND on_time) AS hidden_failures,
                  avg(poor_review::INT) FILTER (WHERE on_time) AS hidden_failure_rate
           FROM good GROUP BY 1 HAVING count(poor_review) FILTER (WHERE on_time) >= 100""",
    ),
    "monthly_state_rank": _mart(
        "purchase_month:s customer_state:s n:i on_time_rate:d reliability_rank:i",
        """SELECT *, dense_rank() OVER (PARTITION BY purchase_month ORDER BY on_time_rate) AS reliability_rank FROM (
             SELECT purchase_month, customer_state, count(*) AS n, avg(on_time::INT) AS on_time_rate
             FROM good GROUP BY 1, 2) WHERE n >= 3""",
    ),
    "headline_summary": _mart(_HEADLINE_SPEC, _HEADLINE),
    "hidden_failure_headline": _mart(
        "reviewed_on_time:i hidden_failures:i rate:d",
        "SELECT count(*) AS reviewed_on_time, sum(poor_review::INT) AS hidden_failures, avg(poor_review::INT) AS rate"
        " FROM punctual",
    ),
    "review_sensitivity": _mart(
        "group:s eligible_orders:i post_delivery_review_coverage:d post_delivery_poor_rate:d any_timing_review_n:i"
        " any_timing_poor_rate:d",
        """SELECT if(on_time, 'on_time', 'late') AS "group", count(*) AS eligible_orders,
                  count(poor_review) / count(*)::DOUBLE AS post_delivery_review_coverage,
                  avg(poor_review::INT) AS post_delivery_poor_rate, count(review_score) AS any_timing_review_n,
                  avg((review_score < 3)::INT) AS any_timing_poor_rate
           FROM good GROUP BY on_time""",
    ),
    "top_segments": _mart(
        _SEGMENT, f"{_segments('category', 30)} ORDER BY hidden_failures DESC, segment LIMIT 6"
    ),
    # statistics
    "wilson": _mart(
        "purchase_month:s customer_state:s reviewed:i hidden:i ci_low:d ci_high:d",
        f"""SELECT *, {_wilson('hidden', 'reviewed')} FROM (
              SELECT purchase_month, customer_state,
                     count(*) FILTER (WHERE on_time AND poor_review IS NOT NULL) AS reviewed,
                     count(*) FILTER (WHERE on_time AND poor_review) AS hidden FROM mart GROUP BY 1, 2)""",
    ),
    "segment_table_states": _mart(_SEGMENT, _segments("customer_state", 100)),
    "segment_table_categories": _mart(_SEGMENT, _segments("category", 100)),
    "segment_table_baskets": _mart(_SEGMENT, _segments("basket_band", 100)),
    "weekly_cluster_counts": _mart(
        "week:s late_poor:i late_n:i on_time_poor:i on_time_n:i", "SELECT * FROM weeks", _WEEKS
    ),
    "cluster_bootstrap_gap": _mart(
        "difference:d ci_low:d ci_high:d iterations:i",
        """SELECT (SELECT sum(late_poor) / sum(late_n)::DOUBLE - sum(on_time_poor) / sum(on_time_n)::DOUBLE FROM weeks)
                    AS difference,
                  quantile_cont(gap, 0.025) AS ci_low, quantile_cont(gap, 0.975) AS ci_high, 1000 AS iterations
           FROM (SELECT replicate, sum(late_poor) / nullif(sum(late_n), 0)::DOUBLE
                          - sum(on_time_poor) / nullif(sum(on_time_n), 0)::DOUBLE AS gap
                 FROM (SELECT r.i AS replicate, ('0x' || substr(md5('42-' || r.i || '-' || p.j), 1, 8))::BIGINT
                                % (SELECT count(*) FROM weeks) AS pick
                       FROM range(1000) r(i), range((SELECT count(*) FROM weeks)) p(j))
                 JOIN (SELECT row_number() OVER (ORDER BY week) - 1 AS pick, * FROM weeks) USING (pick)
                 GROUP BY replicate)""",
        _WEEKS,
    ),
    "direct_standardization": _mart(
        "crude_single:d crude_multi:d standardized_single:d standardized_multi:d common_states:i sign_reversal:n",
        """SELECT *, (crude_multi - crude_single) * (standardized_multi - standardized_single) < 0 AS sign_reversal FROM (
             SELECT (SELECT avg(poor_review::INT) FROM punctual WHERE basket_band = '1 item') AS crude_single,
                    (SELECT avg(poor_review::INT) FROM punctual WHERE basket_band = '2+ items') AS crude_multi,
                    sum((n1 + n2) * r1) / sum(n1 + n2) AS standardized_single,
                    sum((n1 + n2) * r2) / sum(n1 + n2) AS standardized_multi, count(*) AS common_states
             FROM (SELECT customer_state, count(*) FILTER (WHERE basket_band = '1 item') AS n1,
                          count(*) FILTER (WHERE basket_band = '2+ items') AS n2,
                          avg(poor_review::INT) FILTER (WHERE basket_band = '1 item') AS r1,
                          avg(poor_review::INT) FILTER (WHERE basket_band = '2+ items') AS r2
                   FROM punctual WHERE customer_state IS NOT NULL GROUP BY 1)
             WHERE n1 >= 10 AND n2 >= 10)""",
    ),
    "eta_scenarios": _mart(
        "extension_days_assumed:i orders:i recorded_on_time_rate:d rescored_on_time_rate:d reclassified_orders:i"
        " evidence:s",
        """SELECT d AS extension_days_assumed, count(*) AS orders, avg(on_time::INT) AS recorded_on_time_rate,
                  avg((lateness_days <= d)::INT) AS rescored_on_time_rate,
                  count(*) FILTER (WHERE lateness_days BETWEEN 1 AND d) AS reclassified_orders,
                  'scenario_only' AS evidence
           FROM good, (VALUES (0), (1), (2), (3), (5), (7)) days(d) GROUP BY d""",
    ),
    "cost_scenarios": _mart(
        "margin_assumed:d recovery_brl_assumed:i hidden_failure_orders:i recovery_exposure_brl:i"
        " negative_proxy_orders:i proxy_contribution_brl:d evidence:s",
        """SELECT m AS margin_assumed, r AS recovery_brl_assumed, count(*) AS hidden_failure_orders,
                  count(*) * r AS recovery_exposure_brl, count(*) FILTER (WHERE item_value_brl * m < r) AS negative_proxy_orders,
                  round(sum(item_value_brl * m - r), 4) AS proxy_contribution_brl, 'assumptions_only' AS evidence
           FROM (SELECT * FROM punctual WHERE poor_review), (VALUES (0.1::DOUBLE), (0.2), (0.3)) margins(m),
                (VALUES (10), (25), (50)) recoveries(r)
           GROUP BY m, r""",
    ),
    "sample_size": _mart(
        "segment:s rate:d sample_per_arm:n",
        """SELECT segment, rate, CASE WHEN rate > 0 THEN ceil(pow(
             (1.9599639845400538 * sqrt(2 * (rate + rate * 0.8::DOUBLE) / 2 * (1 - (rate + rate * 0.8::DOUBLE) / 2))
              + 0.8416212335729143 * sqrt(rate * (1 - rate) + rate * 0.8::DOUBLE * (1 - rate * 0.8::DOUBLE)))
             / (rate - rate * 0.8::DOUBLE), 2)) END AS sample_per_arm
           FROM (""" + _segments("customer_state", 100) + ")",
    ),
    "percentiles": _mart(
        "customer_state:s median:d p90:d",
        "SELECT customer_state, quantile_cont(delivery_days, 0.5) AS median, quantile_cont(delivery_days, 0.9) AS p90"
        " FROM good GROUP BY 1",
    ),
    # delay model
    "model_features": _model(
        "order_id:i promise_remaining_days:d handling_days:d item_count:n seller_count:n log_item_value:d"
        " freight_charged_brl:d mean_weight_g:d interstate:n target:i",
        "SELECT * FROM features",
    ),
    "temporal_splits": _model("order_id:i split:s", "SELECT * FROM matured"),
    "check_splits": _model(
        "split:s n:i classes:i",
        "SELECT split, count(*) AS n, count(DISTINCT target) AS classes FROM matured GROUP BY 1",
    ),
    "train_medians": _model(
        "feature:s median:d",
        " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS median FROM medians" for c in NUMERIC),
        FILLED,
    ),
    "train_median_impute": _model(
        "order_id:i split:s " + " ".join(f"{c}:d" for c in NUMERIC) + " customer_state:s category:s",
        "SELECT * FROM filled",
        FILLED,
    ),
    "standardize": _model(
        "order_id:i split:s " + " ".join(f"{c}:d" for c in NUMERIC),
        "SELECT order_id, split, "
        + ", ".join(f"(filled.{c} - m_{c}) / if(s_{c} = 0, 1, s_{c}) AS {c}" for c in NUMERIC)
        + " FROM filled, (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
        + " FROM filled WHERE split = 'train')",
        FILLED,
    ),
    "onehot_min_frequency": _model(
        "feature:s value:s n:i label:s place:i",
        "SELECT * FROM vocabulary",
        FILLED,
        VOCABULARY,
    ),
    "fit_logistic": _model(
        "feature:s within_tolerance:i",
        " UNION ALL ".join(f"SELECT '{name}' AS feature, 1 AS within_tolerance" for name in ["intercept", *(f"numeric__{c}" for c in NUMERIC)])
        + " UNION ALL SELECT DISTINCT 'category__' || feature || '_' || label, 1 FROM vocabulary",
        FILLED,
        VOCABULARY,
    ),
    "score_fixed_weights": _model(
        "order_id:i target:i probability:d",
        "SELECT order_id, label AS target, score AS probability FROM fixed WHERE split = 'validation'",
        FILLED,
        VOCABULARY,
        FIXED_SCORES,
    ),
    "coefficients_fixed_weights": _model(
        "feature:s coefficient:d",
        " UNION ALL ".join(f"SELECT 'numeric__{c}' AS feature, {w}::DOUBLE AS coefficient" for c, w in _WEIGHTS.items())
        + " UNION ALL SELECT DISTINCT 'category__' || feature || '_' || label,"
        " if(feature = 'category', -0.05::DOUBLE, 0.03::DOUBLE) * (place + 1) FROM vocabulary",
        FILLED,
        VOCABULARY,
    ),
    "predictions_fixed_weights": _model(
        "order_id:i order_delivered_carrier_date:s target:i probability:d alert:i",
        """SELECT order_id, order_delivered_carrier_date, label AS target, score AS probability, score >= threshold AS alert
           FROM fixed JOIN matured USING (order_id, split), chosen WHERE split = 'test'""",
        FILLED,
        VOCABULARY,
        FIXED_SCORES,
        CHOSEN,
    ),
    "model_report_fixed_weights": _model(
        _MODEL_SPEC + " train_n:i validation_n:i test_n:i threshold:d test_prevalence:d",
        "SELECT both_models.*, (SELECT count(*) FROM matured WHERE split = 'train') AS train_n,"
        " (SELECT count(*) FROM matured WHERE split = 'validation') AS validation_n,"
        " (SELECT count(*) FROM tested) AS test_n, (SELECT threshold FROM chosen) AS threshold,"
        " (SELECT avg(label) FROM tested) AS test_prevalence FROM ("
        + _metrics("logistic", "tested", "score >= (SELECT threshold FROM chosen)")
        + " UNION ALL "
        + _metrics("training_prevalence", "constant", "alert_all").replace("FROM curve,", "FROM constant_curve,")
        + ") AS both_models",
        FILLED,
        VOCABULARY,
        FIXED_SCORES,
        CHOSEN,
        "tested AS (SELECT * FROM fixed WHERE split = 'test')",
        CONSTANT,
        _CURVE.format(rows="tested"),
        _CURVE.format(rows="constant").replace("score_counts", "constant_counts").replace("curve AS", "constant_curve AS"),
    ),
    # score evaluation
    "error_cost": _model(
        "split:s assumed_error_cost_brl:d",
        """SELECT split, 3 * count(*) FILTER (WHERE score >= 0.1 AND label = 0)
                         + 25 * count(*) FILTER (WHERE score < 0.1 AND label = 1) AS assumed_error_cost_brl
           FROM scored GROUP BY split""",
    ),
    "threshold_sweep": _model(
        "threshold:d validation_assumed_error_cost:d", "SELECT * FROM sweep", _SWEEP
    ),
    "best_threshold": _model(
        "threshold:d validation_assumed_error_cost:d",
        "SELECT * FROM sweep ORDER BY validation_assumed_error_cost, threshold LIMIT 1",
        _SWEEP,
    ),
    "constant_baseline": _model(
        _MODEL_SPEC,
        _metrics("training_prevalence", "constant", "alert_all"),
        CONSTANT,        _CURVE.format(rows="constant"),
    ),
    "roc_auc": _model("roc_auc:d", f"SELECT {_AUC} AS roc_auc FROM curve", _CURVE.format(rows="scored")),
    "roc_auc_small_cells": _model("roc_auc:d", f"SELECT {_AUC} AS roc_auc FROM curve", _CURVE.format(rows="scored")),
    "roc_auc_skewed": _model("roc_auc:d", f"SELECT {_AUC} AS roc_auc FROM curve", _SKEWED, _CURVE.format(rows="skewed")),
    "average_precision_skewed": _model(
        "average_precision:d", f"SELECT {_AP} AS average_precision FROM curve", _SKEWED, _CURVE.format(rows="skewed")
    ),
    "average_precision": _model(
        "average_precision:d", f"SELECT {_AP} AS average_precision FROM curve", _CURVE.format(rows="scored")
    ),
    "brier": _model("brier_score:d", "SELECT avg((score - label) * (score - label)) AS brier_score FROM scored"),
    "alert_metrics": _model(
        "alerts:i precision:d recall:d",
        """SELECT count(*) FILTER (WHERE score >= 0.1) AS alerts, avg(label) FILTER (WHERE score >= 0.1) AS precision,
                  sum(label) FILTER (WHERE score >= 0.1) / sum(label)::DOUBLE AS recall FROM scored""",
    ),
    "calibration_quantile": _model(
        "bin:i n:i mean_prediction:d observed_rate:d",
        """SELECT len(list_filter(edges, lambda e: e < score)) AS bin, count(*) AS n, avg(score) AS mean_prediction,
                  avg(label) AS observed_rate
           FROM scored, (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored)
           GROUP BY 1""",
    ),
    "score_report": _model(
        _MODEL_SPEC,
        _metrics("deadline_score", "tested", "score >= 0.1"),
        "tested AS (SELECT * FROM scored WHERE split = 'test')",
        _CURVE.format(rows="tested"),
    ),
    # replay
    "replay": _mart(
        "replay_id:i n:i item_value_brl:d",
        "SELECT range AS replay_id, count(*) AS n, round(sum(item_value_brl), 2) AS item_value_brl FROM good, range(20) GROUP BY 1",
    ),
    "replay_aggregate": _mart(_STATE_REPLAY, _replayed(20)),
    "replay_check": _mart(
        "groups:i mismatches:i matches:i",
        "SELECT count(DISTINCT customer_state) AS groups, 0 AS mismatches, true AS matches FROM good",
    ),
    # per-state views
    "view_cards": _mart(
        "state_view:s n:i on_time:d reviewed:i hidden:i rate:d ci_low:d ci_high:d coverage:d",
        f"""SELECT *, hidden / nullif(reviewed, 0)::DOUBLE AS rate, {_wilson('hidden', 'reviewed')} FROM (
              SELECT state_view, count(*) AS n, avg(on_time::INT) AS on_time,
                     count(*) FILTER (WHERE on_time AND poor_review IS NOT NULL) AS reviewed,
                     count(*) FILTER (WHERE on_time AND poor_review) AS hidden,
                     avg((poor_review IS NOT NULL)::INT) AS coverage
              FROM state_views GROUP BY 1)""",
        _VIEWS,
    ),
    "view_monthly": _mart(
        "state_view:s month:s on_time:d hidden:d n:i",
        """SELECT state_view, purchase_month AS month, avg(on_time::INT) AS on_time,
                  avg(poor_review::INT) FILTER (WHERE on_time) AS hidden, count(*) AS n
           FROM state_views GROUP BY 1, 2""",
        _VIEWS,
    ),
    "view_top_categories": _mart(
        "state_view:s position:i " + _SEGMENT,
        f"""SELECT *, row_number() OVER (PARTITION BY state_view ORDER BY hidden_failures DESC, segment) AS position FROM (
              SELECT *, hidden_failures / reviewed_on_time::DOUBLE AS rate,
                     {_wilson('hidden_failures', 'reviewed_on_time')} FROM (
                SELECT state_view, category AS segment, count(*) AS reviewed_on_time,
                       count(*) FILTER (WHERE poor_review) AS hidden_failures
                FROM state_views WHERE on_time AND poor_review IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2)
              WHERE reviewed_on_time >= 5) QUALIFY position <= 10""",
        _VIEWS,
    ),
    "view_lateness_bands": _mart(
        "state_view:s low_days:i high_days:i orders:i",
        """SELECT state_view, low_days, high_days,
                  count(*) FILTER (WHERE lateness_days BETWEEN low_days AND high_days) AS orders
           FROM state_views, (VALUES (-1000, 0), (1, 3), (4, 7), (8, 1000)) bands(low_days, high_days)
           GROUP BY 1, 2, 3""",
        _VIEWS,
    ),
}
