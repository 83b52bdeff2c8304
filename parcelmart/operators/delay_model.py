"""Logistic delay model on Spark ML over the features of ``features.py``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inference import FALSE_NEGATIVE_COST, FALSE_POSITIVE_COST
from ..sources.staging import scratch, stage
from .features import CATEGORICAL, NUMERIC, SPLITS, fill_missing, medians, scaling, vocabulary
from .scoring import best_threshold, constant_baseline, evaluate, threshold_sweep


@dataclass
class DelayModel:
    """Everything fitted on the training split. ``categories`` stays a DataFrame: value -> position."""

    fills: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    categories: DataFrame
    labels: dict[str, list[str]]
    encoder: OneHotEncoderModel
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0
    classifier: LogisticRegressionModel | None = None

    def feature_names(self) -> list[str]:
        return [f"numeric__{c}" for c in NUMERIC] + [
            f"category__{c}_{label}" for c in CATEGORICAL for label in self.labels[c]
        ]

    def place_weights(self, column: str) -> list[float]:
        """Weights of one category column by position."""
        before = len(NUMERIC) + sum(len(self.labels[c]) for c in CATEGORICAL[: CATEGORICAL.index(column)])
        return self.weights[before : before + len(self.labels[column])]


def _with_positions(df: DataFrame, model: DelayModel) -> DataFrame:
    """Category positions by join, as Spark's size check decides. Unseen values get the position
    after the last one, which the encoder turns into an all-zero vector."""
    for c in CATEGORICAL:
        side = model.categories.filter(F.col("feature") == c).select(
            F.col("value").alias(c), F.col("place").cast("double").alias(f"{c}_place")
        )
        unseen = float(len(model.labels[c]))
        df = df.join(side, c, "left").fillna(unseen, [f"{c}_place"])
    return df


def _inputs(df: DataFrame, model: DelayModel) -> DataFrame:
    """Add ``<number>_z`` and ``<category>_place``."""
    scaled = {
        f"{c}_z": (F.col(c).cast("double") - F.lit(model.means[c])) / F.lit(model.deviations[c]) for c in NUMERIC
    }
    return _with_positions(fill_missing(df, model.fills), model).withColumns(scaled)


_ADDED = [f"{c}_z" for c in NUMERIC] + [f"{c}_place" for c in CATEGORICAL]


def encode(df: DataFrame, model: DelayModel) -> DataFrame:
    """Add the column ``features``: scaled numbers, then one-hot categories."""
    inputs = [f"{c}_z" for c in NUMERIC] + [f"{c}_vector" for c in CATEGORICAL]
    encoded = model.encoder.transform(_inputs(df, model))
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(encoded).drop(*inputs, *_ADDED)


def fit_preprocessing(train: DataFrame, min_frequency: int = 50) -> DelayModel:
    """Medians, scaling and category positions of the training split; only these few values reach the driver."""
    fills = {row["feature"]: row["median"] for row in medians(train).collect()}
    filled = fill_missing(train, fills)
    stats = scaling(filled).first()
    categories = stage(
        vocabulary(filled, min_frequency).select("feature", "value", "label", "place"), "model-categories"
    )
    labels: dict[str, list[str]] = {c: [] for c in CATEGORICAL}
    # One row per output column of the model, whose coefficients the driver holds anyway.
    outputs = categories.groupBy("feature", "label", "place").agg(F.count(F.lit(1)).alias("n"))
    for row in sorted(outputs.collect(), key=lambda r: (r["feature"], r["place"])):
        labels[row["feature"]].append(row["label"])
    # The encoder only needs to know how many positions each category has.
    positions = [
        F.lit(0.0).alias(f"{c}_place", metadata={"ml_attr": {"type": "nominal", "num_vals": len(labels[c])}})
        for c in CATEGORICAL
    ]
    encoder = OneHotEncoder(
        inputCols=[f"{c}_place" for c in CATEGORICAL],
        outputCols=[f"{c}_vector" for c in CATEGORICAL],
        handleInvalid="keep",
        dropLast=True,
    ).fit(train.sparkSession.range(1).select(*positions))
    return DelayModel(
        fills,
        {c: stats[f"{c}_mean"] for c in NUMERIC},
        {c: stats[f"{c}_std"] or 1.0 for c in NUMERIC},
        categories,
        labels,
        encoder,
    )


def fit(train: DataFrame, c: float = 0.3, max_iter: int = 1500, min_frequency: int = 50, tol: float = 1e-6) -> DelayModel:
    """L2-penalized logistic regression; ``c`` is the inverse penalty on the summed loss, the intercept is free.

    The solver keeps blocks of its own rows in memory; rows kept here as well would push these blocks out to disk.
    """
    model = fit_preprocessing(train, min_frequency)
    rows = encode(train, model).select(F.col("target").cast("double").alias("target"), "features")
    n = train.count()
    estimator = LogisticRegression(
        labelCol="target",
        featuresCol="features",
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )
    # A model just solved holds the session, which tasks cannot receive once it has observed anything; one read back does not.
    with scratch(train.sparkSession, "model-classifier") as path:
        estimator.fit(rows).write().save(path)
        model.classifier = LogisticRegressionModel.load(path)
    model.weights = [float(w) for w in model.classifier.coefficients.toArray()]
    model.intercept = model.classifier.intercept
    return model


def _probability(model: DelayModel) -> Column:
    """The logistic function of the weighted inputs; a category value unseen in training weighs nothing."""
    margin = F.lit(model.intercept)
    for c, weight in zip(NUMERIC, model.weights):
        margin = margin + F.lit(weight) * F.col(f"{c}_z")
    for c in CATEGORICAL:
        weights = F.lit(model.place_weights(c)).cast("array<double>")
        margin = margin + F.coalesce(F.get(weights, F.col(f"{c}_place").cast("int")), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def score(model: DelayModel, df: DataFrame) -> DataFrame:
    """Add ``probability`` of a late delivery."""
    return _inputs(df, model).withColumn("probability", _probability(model)).drop(*_ADDED)


def coefficients(model: DelayModel, df: DataFrame) -> DataFrame:
    """Feature names with weights, ascending; one row per coefficient."""
    rows = list(zip(model.feature_names(), model.weights))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double").orderBy(
        "coefficient", "feature"
    )


def penalised_gradients(model: DelayModel, train: DataFrame, c: float = 0.3) -> DataFrame:
    """Derivative of the penalised mean loss by each weight and the intercept; about zero where the fit has converged."""
    residual = F.col("_residual")
    rows = _inputs(train, model).withColumn("_residual", _probability(model) - F.col("target"))
    n = F.count(F.lit(1)).cast("double")
    sums = rows.agg(n.alias("n"), F.sum(residual).alias("all"), *(F.sum(residual * F.col(f"{x}_z")).alias(x) for x in NUMERIC))
    pairs = [F.struct(F.lit("intercept").alias("feature"), F.col("all").alias("total"))]
    pairs += [F.struct(F.lit(f"numeric__{x}").alias("feature"), F.col(x).alias("total")) for x in NUMERIC]
    totals = sums.select(F.inline(F.array(*pairs)))
    for x in CATEGORICAL:
        named = F.get(F.lit([f"category__{x}_{label}" for label in model.labels[x]]), F.col(f"{x}_place").cast("int"))
        totals = totals.unionByName(rows.groupBy(named.alias("feature")).agg(F.sum(residual).alias("total")))
    weights = coefficients(model, train).select("feature", "coefficient")
    gradient = (F.col("total") + F.coalesce("coefficient", F.lit(0.0)) / F.lit(c)) / sums.select("n").scalar()
    return totals.join(weights, "feature", "left").select("feature", gradient.alias("gradient"))


def predictions(scored: DataFrame, threshold: Column) -> DataFrame:
    return scored.select(
        "order_id",
        "order_delivered_carrier_date",
        "target",
        "probability",
        (F.col("probability") >= threshold).alias("alert"),
    )


def chosen_threshold(scored_validation: DataFrame) -> DataFrame:
    return best_threshold(threshold_sweep(scored_validation, "target", "probability"))


def model_report(train: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """Two rows, fitted model and constant baseline, on the test split; validation and test carry ``probability``."""
    threshold = chosen_threshold(validation).select("threshold").scalar()
    fitted = evaluate(test, "target", "probability", F.col("score") >= threshold, "logistic")
    both = fitted.unionByName(constant_baseline(train, validation, test, "target"))
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return both.withColumns(
        {
            "train_n": size(train),
            "validation_n": size(validation),
            "test_n": size(test),
            "threshold": threshold,
            "test_prevalence": test.agg(F.avg("target")).scalar(),
        }
    )


def model_block(report: DataFrame) -> DataFrame:
    """``model_report`` as one nested row, with the assumed error costs and the model's inputs."""
    shared = {*(f"{s}_n" for s in SPLITS), "threshold", "test_prevalence"}
    return report.agg(
        F.struct(*(F.first(f"{s}_n").alias(s) for s in SPLITS)).alias("splits"),
        F.first("threshold").alias("threshold"),
        F.lit(FALSE_POSITIVE_COST).alias("false_positive_cost_assumed"),
        F.lit(FALSE_NEGATIVE_COST).alias("false_negative_cost_assumed"),
        F.first("test_prevalence").alias("test_prevalence"),
        F.sort_array(F.collect_list(F.struct("model", *(c for c in report.columns if c not in {*shared, "model"})))).alias("metrics"),
        F.array(*(F.lit(c) for c in [*NUMERIC, *CATEGORICAL])).alias("features"),
    )
