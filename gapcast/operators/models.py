"""The five regressors: estimator, grid, folds, and how each is fitted at scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    IsotonicRegression,
    IsotonicRegressionModel,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.operators.features import FEATURES, assemble_features
from gapcast.operators.isotonic import condensed
from gapcast.operators.moments import (
    MAX_COLUMNS,
    Moments,
    collect_moments,
    linear_sse,
    points_with_moments,
)
from gapcast.operators.quality import labelled
from gapcast.scratch import ensure_checkpoint_dir


@dataclass(frozen=True)
class ModelSpec:
    name: str
    estimator: type
    model: type
    grid: Mapping[str, Sequence[Any]]
    folds: int
    parallelism: int


# Grid, number of folds and fits at a time of each regressor.
SPECS = {
    s.name: s
    for s in (
        ModelSpec(
            "linear",
            LinearRegression,
            LinearRegressionModel,
            {
                "regParam": [0.001, 0.01, 0.1, 0.5, 1.0, 2.0],
                "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0],
                "maxIter": [1, 5, 10, 20, 50],
            },
            folds=5,
            parallelism=3,
        ),
        ModelSpec(
            "isotonic",
            IsotonicRegression,
            IsotonicRegressionModel,
            {"isotonic": [True, False]},
            folds=5,
            parallelism=3,
        ),
        ModelSpec(
            "decision_tree",
            DecisionTreeRegressor,
            DecisionTreeRegressionModel,
            {"maxDepth": [2, 5, 10, 20, 30], "maxBins": [10, 20, 40, 80, 100]},
            folds=5,
            parallelism=3,
        ),
        ModelSpec(
            "gbt",
            GBTRegressor,
            GBTRegressionModel,
            {"maxDepth": [2, 5, 10], "maxBins": [10, 20, 40], "maxIter": [5, 10, 20]},
            folds=5,
            parallelism=3,
        ),
        ModelSpec(
            "random_forest",
            RandomForestRegressor,
            RandomForestRegressionModel,
            {"maxDepth": [10, 20, 30], "maxBins": [40, 80, 100], "numTrees": [50, 100, 200]},
            folds=2,
            parallelism=2,
        ),
    )
}

# Columns of condensed training tables, named apart from table columns.
POINT, WEIGHT, DEVIATION = "_point", "_weight", "_deviation"

TREES = ("decision_tree", "gbt", "random_forest")
# Rows of a tree learner's table in one task at most, about.
ROWS_PER_TASK = 500_000
DEEP = 20


@dataclass
class FittedModel:
    """A model with what is needed to use it again: label, feature order, parameters."""

    algorithm: str
    label: str
    features: list[str]
    model: Any
    params: dict[str, Any] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    flat: Any = field(default=None, repr=False, compare=False)


def make_estimator(algorithm: str, label: str, params: Mapping[str, Any] | None = None):
    """The MLlib estimator of an algorithm. Deep trees keep node ids between levels."""
    params = dict(params or {})
    if algorithm in TREES and params.get("maxDepth", 0) >= DEEP:
        params.setdefault("cacheNodeIds", True)
    return SPECS[algorithm].estimator(labelCol=label, featuresCol=FEATURES, **params)


def param_grid(algorithm: str, estimator, grid: Mapping[str, Sequence[Any]] | None = None) -> list[dict]:
    """Cartesian grid as parameter maps of the estimator."""
    builder = ParamGridBuilder()
    for name, values in (grid or SPECS[algorithm].grid).items():
        builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def grid_points(algorithm: str, grid: Mapping[str, Sequence[Any]] | None = None) -> list[dict[str, Any]]:
    """The same grid as plain name-value dictionaries, in the same order."""
    grid = grid or SPECS[algorithm].grid
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def training_rows(df: DataFrame, features: Sequence[str], label: str, handle_invalid: str = "error") -> DataFrame:
    """Labelled rows; with ``skip``, only those whose features are all present."""
    rows = labelled(df, label)
    if handle_invalid == "skip":
        for f in features:
            rows = labelled(rows, f)
    return rows


def assembled_rows(df: DataFrame, features: Sequence[str], label: str, *keep: str, handle_invalid: str = "error") -> DataFrame:
    """Label, feature vector and nothing else that a fit does not read."""
    rows = training_rows(df, features, label, handle_invalid)
    return assemble_features(rows, features).select(F.col(label).cast("double").alias(label), FEATURES, *keep)


def dealt_rows(rows: DataFrame) -> DataFrame:
    """The rows of a table for a tree learner, in parts of about ROWS_PER_TASK at most.

    The learner keeps its points and their errors in the parts of its table, and a
    task reads all that is kept of a part at every level. A table is dealt anew only
    if one of its parts has more rows: parts of a file grow with the file.
    """
    parts = rows.groupBy(F.spark_partition_id()).count()
    found = parts.agg(F.max("count").alias("most"), F.sum("count").alias("n"), F.count("*").alias("parts")).first()
    if (found["most"] or 0) <= ROWS_PER_TASK:
        return rows
    return rows.repartition(max(found["parts"], -(-found["n"] // ROWS_PER_TASK)))


# --- linear ---------------------------------------------------------------


def linear_points(spark: SparkSession, moments: Moments, label: str) -> DataFrame:
    return points_with_moments(spark, moments, label, FEATURES, WEIGHT)


def fit_linear_points(points: DataFrame, label: str, params: Mapping[str, Any]) -> LinearRegressionModel:
    return make_estimator("linear", label, params).setWeightCol(WEIGHT).fit(points)


def linear_training_metrics(moments: Moments, model: LinearRegressionModel) -> dict[str, float]:
    """Training RMSE and r2, from the moments."""
    sse = linear_sse(moments, model.coefficients.toArray(), model.intercept)
    total = moments.scatter[-1, -1]
    return {
        "train_rmse": float(np.sqrt(max(sse, 0.0) / moments.n)),
        "train_r2": float(1.0 - sse / total) if total else float("nan"),
    }


def uses_moments(params: Mapping[str, Any], features: Sequence[str]) -> bool:
    return (
        len(features) < MAX_COLUMNS
        and params.get("solver", "auto") in ("auto", "normal")
        and params.get("loss", "squaredError") == "squaredError"
    )


def fit_linear(df, features, label, params, handle_invalid="error", method="auto") -> FittedModel:
    if method == "moments" or (method == "auto" and uses_moments(params, features)):
        rows = training_rows(df, features, label, handle_invalid)
        moments = collect_moments(rows, [*features, label])[0]
        model = fit_linear_points(linear_points(df.sparkSession, moments, label), label, params)
        metrics = linear_training_metrics(moments, model)
    else:
        model = make_estimator("linear", label, params).fit(
            assembled_rows(df, features, label, handle_invalid=handle_invalid)
        )
        summary = model.summary
        metrics = {"train_rmse": summary.rootMeanSquaredError, "train_r2": summary.r2}
    return FittedModel("linear", label, list(features), model, dict(params), metrics)


# --- isotonic -------------------------------------------------------------


def refuse_gaps(rows: DataFrame, feature: str) -> None:
    """Raise if the feature is null or NaN somewhere, as the assembler does."""
    gap = F.col(feature).isNull()
    if dict(rows.dtypes)[feature] in ("double", "float"):
        gap = gap | F.isnan(feature)
    if not rows.filter(gap).isEmpty():
        raise ValueError(f"null or NaN values in ['{feature}']")


def distinct_points(rows: DataFrame, x: str, label: str, *by: str) -> DataFrame:
    """Weight, mean label and squared deviation per distinct feature value.

    An isotonic fit averages equal feature values first, so nothing is lost.
    The counts are combined before the shuffle: a value that fills a third of
    the rows is one row per task.
    """
    y = F.col(label).cast("double")
    return rows.groupBy(*by, F.col(x).cast("double").alias(POINT)).agg(
        F.count("*").cast("double").alias(WEIGHT),
        F.avg(y).alias(label),
        (F.var_pop(y) * F.count("*")).alias(DEVIATION),
    )


def fit_isotonic_points(points: DataFrame, label: str, params: Mapping[str, Any], n: int | None = None) -> IsotonicRegressionModel:
    """Fit to points of distinct feature values. Beyond RANGE_POINTS they are reduced to level stretches first.

    ``n`` is the number of points, or more; they are counted if it is not given.
    """
    params = {k: v for k, v in params.items() if k != "featureIndex"}
    points = condensed(points, POINT, label, WEIGHT, params.get("isotonic", True), n)
    return IsotonicRegression(featuresCol=POINT, labelCol=label, weightCol=WEIGHT, **params).fit(points)


def as_vector_model(model: IsotonicRegressionModel, index: int) -> IsotonicRegressionModel:
    return model.setFeaturesCol(FEATURES).setFeatureIndex(index)


def fit_isotonic(df, features, label, params, handle_invalid="error") -> FittedModel:
    index = params.get("featureIndex", 0)
    rows = training_rows(df, features[index : index + 1], label, handle_invalid)
    refuse_gaps(rows, features[index])
    points = distinct_points(rows, features[index], label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_isotonic_points(points, label, params)
    finally:
        points.unpersist()
    return FittedModel("isotonic", label, list(features), as_vector_model(model, index), dict(params))


# --- all ------------------------------------------------------------------


def fit_model(
    algorithm: str,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: Mapping[str, Any] | None = None,
    handle_invalid: str = "error",
) -> FittedModel:
    """Fit one regressor on the labelled rows of ``df``.

    Linear fits read the table through its moments and isotonic fits through its
    distinct feature values; the trees train on the assembled rows.
    """
    params = dict(params or {})
    features = list(features)
    if algorithm == "linear":
        return fit_linear(df, features, label, params, handle_invalid)
    if algorithm == "isotonic":
        return fit_isotonic(df, features, label, params, handle_invalid)
    ensure_checkpoint_dir(df.sparkSession)
    rows = dealt_rows(assembled_rows(df, features, label, handle_invalid=handle_invalid))
    model = make_estimator(algorithm, label, params).fit(rows)
    return FittedModel(algorithm, label, features, model, params)
