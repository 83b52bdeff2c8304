import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmart.operators.features import NUMERIC, medians
from parcelmart.operators.quantiles import exact_percentiles

PERCENTILES = {"low": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "high": 1.0}


def _samples():
    rng = np.random.default_rng(1)
    return {
        "one": [4.5],
        "two": [1.0, 2.0],
        "three": [3.0, -1.0, 8.0],
        "ties": [1.0] * 500 + [2.0] * 400 + [9.0] * 3,
        "uniform": rng.random(5000).tolist(),
        "heavy": np.exp(rng.normal(0, 4, 4000)).tolist(),
        "signed": np.round(rng.normal(0, 3, 3000), 1).tolist(),
    }


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_grouped_percentiles_are_exact(spark, accuracy):
    samples = _samples()
    rows = [(g, float(v)) for g, values in samples.items() for v in values] + [("ties", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in exact_percentiles(df, F.col("v"), PERCENTILES, ["g"], accuracy).collect()}
    assert set(got) == set(samples) | {None}
    for group, values in samples.items():
        for name, p in PERCENTILES.items():
            assert got[group][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (group, name)


def test_global_percentile(spark):
    values = _samples()["heavy"]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_percentiles(df, F.col("v"), {"p": 0.9}).first().p == pytest.approx(np.quantile(values, 0.9), rel=1e-12)


def test_no_values_give_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_percentiles(df, F.col("v"), {"p": 0.9}).first().p is None


def test_many_groups_need_no_option(spark):
    df = spark.range(100_001).select("id", F.col("id").cast("double").alias("v"))
    got = exact_percentiles(df, F.col("v"), {"p": 0.5}, ["id"])
    assert got.count() == 100_001 and got.filter("p <> id").count() == 0


def test_few_groups_are_not_sorted_by_group(spark):
    """Most of the shuffle partitions would be empty, and Spark then refuses to broadcast the brackets by itself."""
    asked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        train = spark.range(100).select(*(F.col("id").cast("double").alias(c) for c in NUMERIC))
        middle = medians(train)
        assert {r["feature"]: r["median"] for r in middle.collect()} == dict.fromkeys(NUMERIC, 49.5)
        plan = middle._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)
