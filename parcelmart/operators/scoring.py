"""Exact evaluation of a (label, score) table at any size; scores are probabilities, labels 0 or 1, both non-null.

Curves need running counts in score order. ``ranked_scores`` first collapses equal scores, then cuts them into cells at
quantiles of the scores themselves, so that cells are alike in size however the scores are spread; cells that the sketch
has left too large are cut again at quantiles of their own, until none is. Per-cell offsets are added to the running counts
inside each cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import error_cost
from ..functions.search import borders_below
from .quantiles import exact_percentiles

#: Cells that one sketch tells apart.
_CELLS = 1024
# 0.01, 0.02 .. 0.99.
THRESHOLDS = [0.01 + i * 0.01 for i in range(99)]


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Counts per distinct score. A NULL score or label is refused: it has no place in a ranking."""
    missing = F.col(score).isNull() | F.col(label).isNull()
    known = F.when(missing, F.raise_error(F.lit("NULL score or label")).cast("double")).otherwise(F.col(score).cast("double"))
    positive = F.col(label).cast("int") == 1
    return df.groupBy(known.alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def _cut(cells: DataFrame, cell_rows: int) -> DataFrame | None:
    """``cells`` with those of more than twice ``cell_rows`` scores cut at quantiles of their own; None if there are none.

    The borders, fewer than scores / cell_rows, come to the driver: all tasks of later jobs, and those that run again, use the same.
    """
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * cell_rows)
    crowded = {r["cell"]: r["n"] for r in sizes.collect()}
    if not crowded:
        return None
    spark, parts = cells.sparkSession, {c: min(_CELLS, -(-n // cell_rows)) for c, n in crowded.items()}
    few = F.broadcast(spark.createDataFrame(list(parts.items()), "cell long, parts int"))
    sketch = F.percentile_approx("score", [i / _CELLS for i in range(1, _CELLS)], 10 * _CELLS).alias("sketch")
    at = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get("sketch", F.floor(i * F.lit(_CELLS) / F.col("parts")).cast("int") - 1))
    found = cells.join(few, "cell").groupBy("cell", "parts").agg(sketch).select("cell", at.alias("borders")).collect()
    borders = F.broadcast(spark.createDataFrame(found, "cell long, borders array<double>"))
    split = cells.join(borders, "cell", "left")
    below = F.when(F.col("borders").isNotNull(), borders_below(F.col("borders"), F.col("score"), _CELLS)).otherwise(0)
    return split.select("score", "pos", "neg", (F.col("cell") * _CELLS + below).alias("cell"))


def score_cells(counts: DataFrame, cell_rows: int) -> tuple[DataFrame, int]:
    """``counts``, one row per distinct score, with a cell that rises with the score, and how often cells were cut.

    All scores are one cell at first; cells are cut until none holds more than twice ``cell_rows`` scores.
    """
    cells, rounds = counts.withColumn("cell", F.lit(0).cast("long")), 0
    while (finer := _cut(cells, cell_rows)) is not None:
        cells, rounds = finer, rounds + 1
    return cells, rounds


def ranked_scores(df: DataFrame, label: str, score: str, cell_rows: int = 1_000_000) -> DataFrame:
    """One row per distinct score with ``tp`` and ``fp``: positives and negatives scored at or above it."""
    cells, rounds = score_cells(score_counts(df, label, score), cell_rows)
    in_cell = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp = F.sum("pos").over(in_cell), F.sum("neg").over(in_cell)
    if not rounds:
        return cells.select("score", "pos", "neg", tp.alias("tp"), fp.alias("fp"))
    # One row per cell, so many as the distinct scores divided by cell_rows: one task can add them up.
    before = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sums.select("cell", offset("pos").alias("tp_before"), offset("neg").alias("fp_before"))
    return cells.join(offsets, "cell").select("score", "pos", "neg", (F.col("tp_before") + tp).alias("tp"), (F.col("fp_before") + fp).alias("fp"))


def _auc() -> Column:
    """Positives above each negative, ties counting half, over all pairs."""
    above = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return F.try_divide(above, F.sum("pos").cast("double") * F.sum("neg"))


def _average_precision() -> Column:
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos"))


def _brier() -> Column:
    miss = F.lit(1.0) - F.col("score")
    squared = F.col("pos") * miss * miss + F.col("neg") * F.col("score") * F.col("score")
    return F.try_divide(F.sum(squared), F.sum(F.col("pos") + F.col("neg")))


def roc_auc(df: DataFrame, label: str, score: str, cell_rows: int = 1_000_000) -> DataFrame:
    return ranked_scores(df, label, score, cell_rows).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, cell_rows: int = 1_000_000) -> DataFrame:
    """Step-wise, not trapezoidal: precision at each distinct score weighted by the recall it adds."""
    return ranked_scores(df, label, score, cell_rows).agg(_average_precision().alias("average_precision"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    return score_counts(df, label, score).agg(_brier().alias("brier_score"))


def thresholds_met(score: Column, thresholds: Sequence[float] = THRESHOLDS) -> Column:
    """How many of the hundredths 0.01 .. 0.99 are at most ``score``: a guess, corrected by exact comparison."""
    grid = F.array(*(F.lit(t) for t in thresholds))
    last = len(thresholds)
    guess = F.least(F.greatest(F.floor(score * 100), F.lit(0)), F.lit(last)).cast("int")
    return (
        F.when((guess < last) & (score >= F.get(grid, guess)), guess + 1)
        .when((guess > 0) & (score < F.get(grid, guess - 1)), guess - 1)
        .otherwise(guess)
    )


def threshold_sweep(
    df: DataFrame, label: str, score: str, false_positive: float = 3.0, false_negative: float = 25.0
) -> DataFrame:
    """Assumed error cost of alerting at or above each threshold; rows are reduced to 100 cells first."""
    positive = F.col(label).cast("int") == 1
    cells = df.groupBy(thresholds_met(F.col(score)).alias("met")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    grid = df.sparkSession.range(len(THRESHOLDS) + 1).select(F.col("id").cast("int").alias("met"))
    # A window over 100 rows: false negatives lie below a threshold, false positives at or above it.
    below = Window.orderBy("met").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("met").rowsBetween(0, Window.unboundedFollowing)
    swept = grid.join(F.broadcast(cells), "met", "left").select(
        "met",
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"),
    )
    cost = F.col("fp") * F.lit(false_positive) + F.col("fn") * F.lit(false_negative)
    values = F.array(*(F.lit(t) for t in THRESHOLDS))
    return (
        swept.filter("met > 0")
        .select(F.get(values, F.col("met") - 1).alias("threshold"), cost.alias("validation_assumed_error_cost"))
        .orderBy("threshold")
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Cheapest threshold; the lowest one if several cost the same."""
    return sweep.orderBy("validation_assumed_error_cost", "threshold").limit(1)


def total_error_cost(
    df: DataFrame, label: str, predicted: Column, false_positive: float = 3.0, false_negative: float = 25.0
) -> DataFrame:
    cost = error_cost(F.col(label), predicted, false_positive, false_negative)
    return df.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("assumed_error_cost_brl"))


def alert_metrics(df: DataFrame, label: str, alert: Column) -> DataFrame:
    positive = F.col(label).cast("int") == 1
    counts = df.select(positive.alias("p"), alert.alias("a")).agg(
        F.count_if("a").alias("alerts"), F.count_if(F.col("a") & F.col("p")).alias("hits"), F.count_if("p").alias("p")
    )
    return counts.select(
        "alerts",
        F.try_divide("hits", "alerts").alias("precision"),
        F.try_divide("hits", "p").alias("recall"),
    )


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in quantile bins; a score equal to an edge belongs to the lower bin."""
    edges = exact_percentiles(df, F.col(score), {f"e{i}": i / bins for i in range(1, bins)})
    inner = edges.select(F.array(*(F.col(f"e{i}") for i in range(1, bins)))).scalar()
    position = F.lit(0)
    for i in range(bins - 1):
        position = position + (F.col(score) > F.get("_edges", F.lit(i))).cast("int")
    return (
        df.withColumn("_edges", inner)
        .groupBy(position.cast("bigint").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("mean_prediction"),
            F.avg(F.col(label).cast("int")).alias("observed_rate"),
        )
    )


def evaluate(
    df: DataFrame,
    label: str,
    score: str,
    alert: Column,
    model: str,
    false_positive: float = 3.0,
    false_negative: float = 25.0,
) -> DataFrame:
    """All metrics of one model in one row. ``alert`` is a condition on the column ``score``."""
    return _metrics(ranked_scores(df, label, score), alert, model, false_positive, false_negative)


def _metrics(
    ranked: DataFrame, alert: Column, model: str, false_positive: float = 3.0, false_negative: float = 25.0
) -> DataFrame:
    rows = ranked.withColumn("alert", alert)
    alerted = lambda c: F.coalesce(F.sum(F.when(F.col("alert"), F.col(c))), F.lit(0))
    totals = rows.agg(
        _auc().alias("roc_auc"),
        _average_precision().alias("average_precision"),
        _brier().alias("brier_score"),
        F.sum("pos").alias("p"),
        alerted("pos").alias("hits"),
        alerted("neg").alias("false_alerts"),
    )
    missed = F.col("p") - F.col("hits")
    return totals.select(
        F.lit(model).alias("model"),
        "roc_auc",
        "average_precision",
        "brier_score",
        (F.col("false_alerts") * F.lit(false_positive) + missed * F.lit(false_negative)).alias(
            "assumed_error_cost_brl"
        ),
        (F.col("hits") + F.col("false_alerts")).alias("alerts"),
        F.try_divide(F.col("hits"), F.col("hits") + F.col("false_alerts")).alias("precision"),
        F.try_divide(F.col("hits"), F.col("p")).alias("recall"),
    )


def constant_baseline(train: DataFrame, validation: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Metrics of the constant training prevalence; it alerts on everything only if that is cheaper on validation."""
    prevalence = train.agg(F.avg(F.col(label).cast("int"))).scalar()
    alert_all = validation.agg(
        F.sum(error_cost(F.col(label), F.lit(True))) < F.sum(error_cost(F.col(label), F.lit(False)))
    ).scalar()
    # A single distinct score: every row is at or above it.
    one_score = score_counts(test.select(label).withColumn("score", prevalence), label, "score")
    ranked = one_score.withColumns({"tp": F.col("pos"), "fp": F.col("neg")})
    return _metrics(ranked, alert_all, "training_prevalence")
