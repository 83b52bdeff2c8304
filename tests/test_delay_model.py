from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import at
from parcelmart.operators import delay_model as D
from parcelmart.operators import features as X
from parcelmart.operators.contracts import ContractError


def test_no_outcome_is_a_feature():
    outcomes = {"lateness_days", "delivery_days", "transit_days", "review_score", "poor_review", "on_time", "target"}
    assert not outcomes & set(X.NUMERIC + X.CATEGORICAL)


def test_labels_must_be_known_before_the_next_window(spark):
    rows = [("2018-03-01", "2018-03-05"), ("2018-03-30", "2018-04-05"), ("2018-04-01", "2018-04-03"), ("2018-06-01", "2018-06-03")]
    df = spark.createDataFrame(
        [(i, at(a), at(b)) for i, (a, b) in enumerate(rows)],
        "i int, order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz",
    )
    assert {r.i: r.split for r in X.temporal_splits(df).collect()} == {0: "train", 2: "validation", 3: "test"}


@pytest.fixture(scope="module")
def rows(spark):
    """Orders over eight months whose lateness depends on the inputs; some inputs are missing."""
    rng = np.random.default_rng(2)
    out = []
    for i in range(1200):
        handed = datetime(2018, 1, 1) + timedelta(hours=int(rng.integers(0, 24 * 200)))
        promise, handling = float(rng.integers(1, 20)), float(rng.random() * 5)
        state, category = str(rng.choice(list("ABCD"), p=[0.5, 0.3, 0.19, 0.01])), rng.choice(["x", "y", None])
        late = rng.random() < 1 / (1 + np.exp(0.3 * promise - handling + (state == "A")))
        weight = None if rng.random() < 0.2 else float(rng.integers(100, 900))
        out.append(
            (
                f"o{i}", True, not bool(late), True, state, category if category else None, handling,
                int(rng.integers(1, 4)), 1, float(rng.random() * 100), float(rng.random() * 20), weight, int(rng.integers(0, 2)),
                handed, handed + timedelta(days=2), handed + timedelta(days=promise),
            )
        )
    return spark.createDataFrame(
        out,
        "order_id string, eligible boolean, on_time boolean, valid_stages boolean, customer_state string, category string,"
        " handling_days double, item_count int, seller_count int, item_value_brl double, freight_charged_brl double,"
        " mean_weight_g double, interstate int, order_delivered_carrier_date timestamp_ntz,"
        " order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )


@pytest.fixture(scope="module")
def split(rows):
    df = X.temporal_splits(X.model_features(rows)).persist()
    return {name: df.filter(F.col("split") == name) for name in X.SPLITS} | {"all": df}


def test_features(rows):
    r = X.model_features(rows).orderBy("order_id").first()
    deadline = datetime.combine(r.order_estimated_delivery_date.date(), datetime.min.time()) + timedelta(days=1)
    assert r.promise_remaining_days == pytest.approx((deadline - r.order_delivered_carrier_date).total_seconds() / 86400)
    assert r.log_item_value == pytest.approx(np.log1p(r.item_value_brl))
    assert r.target == int(not r.on_time)


def test_weak_splits_are_refused(split):
    assert set(X.check_splits(split["all"])) == set(X.SPLITS)
    with pytest.raises(ContractError, match="test"):
        X.check_splits(split["all"].filter("split <> 'test'"))
    with pytest.raises(ContractError, match="validation"):
        X.check_splits(split["all"].filter("split <> 'validation' OR target = 0"))


def test_preprocessing_uses_the_training_split_only(split):
    train = split["train"].toPandas()
    filled = X.impute(split["test"], split["train"]).toPandas()
    missing = split["test"].toPandas().mean_weight_g.isna().to_numpy()
    assert missing.any()
    assert set(filled.mean_weight_g[missing]) == {train.mean_weight_g.median()}
    assert "unknown" in set(filled.category)
    scaled = X.standardize(split["test"], split["train"]).toPandas()
    expected = (split["test"].toPandas().handling_days - train.handling_days.mean()) / train.handling_days.std(ddof=0)
    assert np.allclose(scaled.handling_days, expected)
    assert set(scaled.seller_count) == {0.0}


def test_vocabulary_puts_rare_values_last(split):
    filled = X.fill_missing(split["train"], {})
    got = {(r.feature, r.value): (r.place, r.label) for r in X.vocabulary(filled, 50).collect()}
    assert [got[("customer_state", s)] for s in "ABC"] == [(0, "A"), (1, "B"), (2, "C")]
    assert got[("customer_state", "D")] == (3, "infrequent")
    assert [got[("category", c)][0] for c in ("unknown", "x", "y")] == [0, 1, 2]


def _newton(x, y, c):
    """Minimize c * log loss + |w|^2 / 2 with a free intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = c * z.T @ (p - y) + ridge @ w
        w -= np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + ridge, gradient)
    return w


def test_fit_matches_a_newton_solve(split):
    model = D.fit(split["train"], min_frequency=50)
    encoded = D.encode(split["train"], model).select("features", "target").collect()
    x = np.array([r.features.toArray() for r in encoded])
    y = np.array([r.target for r in encoded])
    assert x.shape[1] == len(model.feature_names()) == 8 + 4 + 3
    assert (x[:, 8:].sum(axis=1) == 2).all()
    expected = _newton(x, y, 0.3)
    assert np.allclose(model.classifier.coefficients.toArray(), expected[:-1], atol=1e-4)
    assert model.classifier.intercept == pytest.approx(expected[-1], abs=1e-4)
    table = D.coefficients(model, split["train"]).toPandas()
    assert table.coefficient.is_monotonic_increasing and "category__customer_state_infrequent" in set(table.feature)


def test_rows_of_the_fit_are_cached_by_the_solver_alone(split, monkeypatch):
    given, solve = [], D.LogisticRegression.fit
    monkeypatch.setattr(D.LogisticRegression, "fit", lambda self, rows: given.append(rows.storageLevel) or solve(self, rows))
    D.fit(split["train"], min_frequency=50)
    assert [level.useMemory or level.useDisk for level in given] == [False]


def test_no_task_of_the_fit_sorts_a_whole_column(spark, split, monkeypatch):
    """Where Spark refuses to broadcast by itself, the largest task of ``model_report`` was the sort of one column."""
    asked, found, middles = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], D.medians
    monkeypatch.setattr(D, "medians", lambda train: found.append(middles(train)) or found[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert set(D.fit_preprocessing(split["train"], 50).fills) == set(X.NUMERIC)
        plan = found[0]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)


def test_scores_are_those_of_the_classifier_and_gradients_vanish(split):
    model = D.fit(split["train"], min_frequency=50)
    strange = split["test"].unionByName(split["test"].limit(1).withColumns({"order_id": F.lit("odd"), "category": F.lit("never seen")}))
    ours = {r.order_id: r.probability for r in D.score(model, strange).collect()}
    theirs = {r.order_id: r.probability[1] for r in model.classifier.transform(D.encode(strange, model)).collect()}
    assert ours == pytest.approx(theirs, abs=1e-12)
    gradients = {r.feature: r.gradient for r in D.penalised_gradients(model, split["train"]).collect()}
    assert set(gradients) == {"intercept", *model.feature_names()}
    assert max(map(abs, gradients.values())) < 1e-4
    model.weights = [w + 0.1 for w in model.weights]
    assert max(abs(r.gradient) for r in D.penalised_gradients(model, split["train"]).collect()) > 1e-3


def test_the_classifier_reaches_tasks_after_an_observation(spark, split):
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    model = D.fit(split["train"], min_frequency=50)
    scored = model.classifier.transform(D.encode(split["test"], model)).select("probability").collect()
    assert seen.get == {"n": 3} and len(scored) == split["test"].count()


def test_unseen_category_becomes_a_zero_vector(split):
    model = D.fit_preprocessing(split["train"], 50)
    strange = split["test"].limit(1).withColumns({"customer_state": F.lit("Z"), "category": F.lit("never seen")})
    assert D.encode(strange, model).first().features.toArray()[8:].tolist() == [0.0] * 7


def test_report_and_predictions(split):
    model = D.fit(split["train"])
    validation, test = (D.score(model, split[s]).select("order_id", "order_delivered_carrier_date", "target", "probability").persist() for s in ("validation", "test"))
    report = {r.model: r for r in D.model_report(split["train"], validation, test).collect()}
    assert set(report) == {"logistic", "training_prevalence"}
    assert report["logistic"].roc_auc > 0.7 > report["training_prevalence"].roc_auc == 0.5
    assert report["logistic"].train_n == split["train"].count()
    alerts = D.predictions(test, D.chosen_threshold(validation).select("threshold").scalar())
    assert alerts.filter("alert").count() == report["logistic"].alerts
    assert alerts.columns == ["order_id", "order_delivered_carrier_date", "target", "probability", "alert"]
