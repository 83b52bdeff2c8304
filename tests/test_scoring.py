import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmart.operators import scoring as V


def _data(kind, n=1500):
    rng = np.random.default_rng(11)
    score = {
        "spread": rng.random(n),
        "ties": np.round(rng.random(n), 2),
        "crowded": 0.5 + rng.random(n) * 1e-7,
        "ends": rng.choice([0.0, 1.0, 0.3], n),
    }[kind]
    label = (rng.random(n) < 0.2 + 0.5 * (score - score.min()) / (np.ptp(score) or 1)).astype(int)
    return label, score


def _frame(spark, label, score):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(label, score)], "y int, s double").repartition(5)


def _auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean([np.mean((p > neg) + 0.5 * (p == neg)) for p in pos])


def _average_precision(label, score):
    total = 0.0
    for s in np.unique(score):
        at_or_above = score >= s
        total += label[score == s].sum() / label.sum() * label[at_or_above].mean()
    return total


@pytest.mark.parametrize("kind", ["spread", "ties", "crowded", "ends"])
@pytest.mark.parametrize("cell_rows", [7, 1_000_000])
def test_auc_and_average_precision(spark, kind, cell_rows):
    label, score = _data(kind)
    df = _frame(spark, label, score)
    assert V.roc_auc(df, "y", "s", cell_rows).first()[0] == pytest.approx(_auc(label, score), abs=1e-12)
    assert V.average_precision(df, "y", "s", cell_rows).first()[0] == pytest.approx(_average_precision(label, score), abs=1e-12)


@pytest.mark.parametrize("kind", ["fourth power", "two heaps", "tiny range", "logarithmic"])
def test_cells_are_small_however_scores_are_spread(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    n, wanted = 60_000, 300
    x = rng.random(n)
    score = {
        "fourth power": x**4 / 20,
        "two heaps": np.where(x < 0.999, 0.3 + x * 1e-9, x),
        "tiny range": 0.5 + x * 1e-9,
        "logarithmic": 10.0 ** (-300 * x),
    }[kind]
    label = (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(label, score)], "y int, s double").repartition(5)
    monkeypatch.setattr(V, "_CELLS", 64)  # so that cells are cut more than once
    cells, rounds = V.score_cells(V.score_counts(df, "y", "s"), wanted)
    assert rounds >= 1
    spans = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("cell").collect()
    assert max(r.n for r in spans) <= 2 * wanted and len(spans) < 8 * n / wanted
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]))
    ranked = {s: i for i, s in enumerate(np.unique(-score))}
    rank = np.array([ranked[s] for s in -score])
    pos, neg = rank[label == 1], np.sort(rank[label == 0])
    below, upto = np.searchsorted(neg, pos, "left"), np.searchsorted(neg, pos, "right")
    auc = np.mean((len(neg) - upto + 0.5 * (upto - below)) / len(neg))
    assert V.roc_auc(df, "y", "s", wanted).first()[0] == pytest.approx(auc, abs=1e-12)


def test_one_class_has_no_auc(spark):
    df = _frame(spark, [1, 1], [0.2, 0.4])
    assert V.roc_auc(df, "y", "s").first()[0] is None


@pytest.mark.parametrize("kind", ["spread", "ties", "ends"])
def test_sweep_and_best_threshold(spark, kind):
    label, score = _data(kind)
    sweep = V.threshold_sweep(_frame(spark, label, score), "y", "s")
    rows = sweep.collect()
    thresholds = np.linspace(0.01, 0.99, 99)
    cost = [3 * ((score >= t) & (label == 0)).sum() + 25 * ((score < t) & (label == 1)).sum() for t in thresholds]
    assert [r[0] for r in rows] == pytest.approx(thresholds.tolist())
    assert [r[1] for r in rows] == cost
    assert V.best_threshold(sweep).first().threshold == pytest.approx(thresholds[int(np.argmin(cost))])


@pytest.mark.parametrize("kind", ["spread", "ties", "ends"])
def test_calibration(spark, kind):
    label, score = _data(kind)
    got = {r.bin: (r.mean_prediction, r.observed_rate) for r in V.calibration(_frame(spark, label, score), "y", "s").collect()}
    edges = np.percentile(score, np.linspace(0, 100, 11))
    bins = np.searchsorted(edges[1:-1], score)
    assert set(got) == set(bins.tolist())
    for b in set(bins.tolist()):
        assert got[b] == (pytest.approx(score[bins == b].mean()), pytest.approx(label[bins == b].mean()))


def test_evaluate_agrees_with_its_parts(spark):
    label, score = _data("ties")
    df = _frame(spark, label, score)
    row = V.evaluate(df, "y", "s", F.col("score") >= 0.4, "m").first()
    alert = F.col("s") >= 0.4
    parts = V.alert_metrics(df, "y", alert).first()
    assert (row.alerts, row.precision, row.recall) == (parts.alerts, parts.precision, parts.recall)
    assert row.assumed_error_cost_brl == V.total_error_cost(df, "y", alert).first()[0]
    assert row.brier_score == pytest.approx(np.mean((score - label) ** 2))
    assert V.brier(df, "y", "s").first()[0] == pytest.approx(np.mean((score - label) ** 2))
    assert row.roc_auc == pytest.approx(_auc(label, score))


def test_no_alerts_leave_precision_unknown(spark):
    row = V.alert_metrics(_frame(spark, [1, 0], [0.1, 0.2]), "y", F.col("s") >= 0.9).first()
    assert tuple(row) == (0, None, 0.0)


@pytest.mark.parametrize("late_in_validation,alerts", [(0, 0), (5, 10)])
def test_baseline_alerts_only_when_cheaper(spark, late_in_validation, alerts):
    train = _frame(spark, [1, 0, 0, 0], [0] * 4)
    validation = _frame(spark, [1] * late_in_validation + [0] * 10, [0] * (10 + late_in_validation))
    test = _frame(spark, [1] * 3 + [0] * 7, [0] * 10)
    row = V.constant_baseline(train, validation, test, "y").first()
    assert row.roc_auc == 0.5 and row.average_precision == pytest.approx(0.3) and row.alerts == alerts
    assert row.brier_score == pytest.approx(0.3 * 0.75**2 + 0.7 * 0.25**2)


def test_null_scores_and_labels_are_refused(spark):
    for rows in ([(1, 0.9), (0, None)], [(None, 0.4), (0, 0.1)]):
        with pytest.raises(Exception, match="NULL score or label"):
            V.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect()
