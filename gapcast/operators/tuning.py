"""Grid search with cross-validation, and the comparison of the winners.

The result is that of an exhaustive grid over the folds: mean RMSE per grid
point, least mean wins, winner refitted on all rows. What differs per algorithm
is how often the table is read:

* linear: once (plus its means), whatever the grid, through moments per fold;
* isotonic: once, to distinct feature values per fold;
* boosted trees: one fit per fold and tree shape, as the boosting rounds of a
  long run contain every shorter run;
* tree and forest: one fit per fold and bins, to the greatest depth and number of
  trees; smaller ones are read off it, cut off at their depth and after their
  number of trees. A tree cut off at a depth is the tree that a fit to that depth
  finds; a forest's first trees are a forest of their own, as good as one with
  another seed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add
from typing import Any

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.operators.flat_models import flat_trees, truncated_errors
from gapcast.operators.models import (
    DEVIATION,
    POINT,
    SPECS,
    WEIGHT,
    FittedModel,
    uses_moments,
    as_vector_model,
    assembled_rows,
    dealt_rows,
    distinct_points,
    fit_isotonic_points,
    fit_linear_points,
    fit_model,
    grid_points,
    linear_points,
    linear_training_metrics,
    make_estimator,
    param_grid,
    refuse_gaps,
    training_rows,
)
from gapcast.operators.moments import collect_moments, linear_sse
from gapcast.operators.scoring import score_test
from gapcast.operators.split import kfold
from gapcast.scratch import ensure_checkpoint_dir


@dataclass
class TuningResult:
    algorithm: str
    label: str
    points: list[dict[str, Any]]
    mean_rmse: list[float]
    best: FittedModel

    @property
    def best_point(self) -> int:
        return int(np.argmin(self.mean_rmse))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per grid point, in grid order."""
        rows = [
            (self.algorithm, self.label, i, json.dumps(p, sort_keys=True), float(r), i == self.best_point)
            for i, (p, r) in enumerate(zip(self.points, self.mean_rmse))
        ]
        return spark.createDataFrame(
            rows, "algorithm string, label string, point int, params string, mean_rmse double, best boolean"
        )


def _in_threads(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """A few fits at a time from the driver; their jobs share the cluster."""
    pool = ThreadPool(processes=max(1, min(parallelism, len(items))))
    try:
        return pool.map(inheritable_thread_target(spark)(work), items)
    finally:
        pool.close()


def cross_validator(
    algorithm: str,
    label: str,
    grid: Mapping[str, Sequence[Any]] | None = None,
    folds: int | None = None,
    parallelism: int | None = None,
    fold_col: str = "",
    seed: int = 0,
) -> CrossValidator:
    """The plain MLlib cross-validator of an algorithm's grid."""
    spec = SPECS[algorithm]
    estimator = make_estimator(algorithm, label)
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=param_grid(algorithm, estimator, grid),
        evaluator=RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse"),
        numFolds=folds or spec.folds,
        parallelism=parallelism or spec.parallelism,
        foldCol=fold_col,
        seed=seed,
    )


def _tune_linear(rows, features, label, points, folds, parallelism, fold_col):
    spark = rows.sparkSession
    per_fold = collect_moments(rows, [*features, label], by=fold_col)
    _check_folds(per_fold, folds)

    rest = {
        f: linear_points(spark, reduce(add, [m for k, m in per_fold.items() if k != f]), label) for f in per_fold
    }

    def fold_error(job):
        params, fold = job
        model = fit_linear_points(rest[fold], label, params)
        sse = linear_sse(per_fold[fold], model.coefficients.toArray(), model.intercept)
        return np.sqrt(max(sse, 0.0) / per_fold[fold].n)

    jobs = [(p, f) for p in points for f in range(folds)]
    errors = np.array(_in_threads(spark, fold_error, jobs, parallelism)).reshape(len(points), folds)
    means = errors.mean(axis=1)

    best = points[int(np.argmin(means))]
    total = reduce(add, per_fold.values())
    model = fit_linear_points(linear_points(spark, total, label), label, best)
    fitted = FittedModel("linear", label, list(features), model, dict(best), linear_training_metrics(total, model))
    return means, fitted


def _merge_points(points: DataFrame, label: str) -> DataFrame:
    """Points of several folds as one point per feature value."""
    weight = F.sum(WEIGHT)
    return points.groupBy(POINT).agg(
        weight.alias(WEIGHT), (F.sum(F.col(WEIGHT) * F.col(label)) / weight).alias(label)
    )


def _tune_isotonic(rows, features, label, points, folds, parallelism, fold_col):
    spark = rows.sparkSession
    index = points[0].get("featureIndex", 0)
    refuse_gaps(rows, features[index])
    stats = distinct_points(rows, features[index], label, fold_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = stats.groupBy(fold_col).count().collect()  # a row per fold
        _check_folds({r[fold_col] for r in found}, folds)
        most = sum(r["count"] for r in found)

        def fold_error(job):
            params, fold = job
            model = fit_isotonic_points(_merge_points(stats.filter(F.col(fold_col) != fold), label), label, params, most)
            scored = model.transform(stats.filter(F.col(fold_col) == fold))
            gap = F.col(WEIGHT) * F.pow(F.col(label) - F.col("prediction"), 2)
            return scored.agg(F.sqrt(F.sum(F.col(DEVIATION) + gap) / F.sum(WEIGHT)).alias("rmse")).first()["rmse"]

        jobs = [(p, f) for p in points for f in range(folds)]
        errors = np.array(_in_threads(spark, fold_error, jobs, parallelism)).reshape(len(points), folds)
        means = errors.mean(axis=1)
        best = points[int(np.argmin(means))]
        model = fit_isotonic_points(_merge_points(stats, label), label, best, most)
        return means, FittedModel("isotonic", label, list(features), as_vector_model(model, index), dict(best))
    finally:
        stats.unpersist()


def _tune_gbt(rows, features, label, points, folds, parallelism, fold_col):
    spark = rows.sparkSession

    def shape_of(params):
        return {k: v for k, v in params.items() if k != "maxIter"}

    def rounds_of(params):
        return params.get("maxIter", 20)

    shapes: list[dict] = []
    for p in points:
        if shape_of(p) not in shapes:
            shapes.append(shape_of(p))

    table = dealt_rows(assembled_rows(rows, features, label, fold_col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _check_folds({r[fold_col] for r in table.select(fold_col).distinct().collect()}, folds)

        def fold_errors(job):
            shape, fold = job
            rounds = max(rounds_of(p) for p in points if shape_of(p) == shape)
            model = make_estimator("gbt", label, {**shape, "maxIter": rounds}).fit(table.filter(F.col(fold_col) != fold))
            return model.evaluateEachIteration(table.filter(F.col(fold_col) == fold), "squared")

        jobs = [(s, f) for s in shapes for f in range(folds)]
        curves = _in_threads(spark, fold_errors, jobs, parallelism)  # squared error after each round

        def mean_rmse(params):
            mine = [curve for (shape, _), curve in zip(jobs, curves) if shape == shape_of(params)]
            return np.mean([np.sqrt(curve[rounds_of(params) - 1]) for curve in mine])

        means = np.array([mean_rmse(p) for p in points])
        best = points[int(np.argmin(means))]
        model = make_estimator("gbt", label, best).fit(table)
        return means, FittedModel("gbt", label, list(features), model, dict(best))
    finally:
        table.unpersist()


def _tune_trees(algorithm, rows, features, label, points, folds, parallelism, fold_col):
    """Errors of all depths and numbers of trees from the largest fit of each fold and shape."""
    spark, own = rows.sparkSession, make_estimator(algorithm, label)

    def size_of(params):
        depth = params.get("maxDepth", own.getMaxDepth())
        return depth, params.get("numTrees", own.getNumTrees()) if algorithm == "random_forest" else 1

    def shape_of(params):
        return {k: v for k, v in params.items() if k not in ("maxDepth", "numTrees")}

    shapes: list[dict] = []
    for p in points:
        if shape_of(p) not in shapes:
            shapes.append(shape_of(p))

    table = dealt_rows(assembled_rows(rows, features, label, fold_col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _check_folds({r[fold_col] for r in table.select(fold_col).distinct().collect()}, folds)

        def fold_errors(job):
            shape, fold = job
            depths, counts = zip(*[size_of(p) for p in points if shape_of(p) == shape])
            largest = {"maxDepth": max(depths)} | ({"numTrees": max(counts)} if algorithm == "random_forest" else {})
            model = make_estimator(algorithm, label, {**shape, **largest}).fit(table.filter(F.col(fold_col) != fold))
            flat = flat_trees(spark, model, [1.0])
            return truncated_errors(flat, table.filter(F.col(fold_col) == fold), label, depths, counts)

        jobs = [(s, f) for s in shapes for f in range(folds)]
        errors = _in_threads(spark, fold_errors, jobs, parallelism)

        def mean_rmse(params):
            return np.mean([e[size_of(params)] for (shape, _), e in zip(jobs, errors) if shape == shape_of(params)])

        means = np.array([mean_rmse(p) for p in points])
        best = points[int(np.argmin(means))]
        model = make_estimator(algorithm, label, best).fit(table)
        return means, FittedModel(algorithm, label, list(features), model, dict(best))
    finally:
        table.unpersist()


def _tune_rows(algorithm, rows, features, label, points, grid, folds, parallelism, fold_col):
    table = assembled_rows(rows, features, label, fold_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        validator = cross_validator(algorithm, label, grid, folds, parallelism, fold_col)
        result = validator.fit(table)
        best = points[int(np.argmin(result.avgMetrics))]
        return np.array(result.avgMetrics), FittedModel(algorithm, label, list(features), result.bestModel, dict(best))
    finally:
        table.unpersist()


def _check_folds(present, folds: int) -> None:
    if sorted(present) != list(range(folds)):
        raise ValueError(f"fold numbers must be exactly 0 to {folds - 1}, found {sorted(present)}")


def _sequential_rounds(points) -> bool:
    """Boosting is repeatable round by round when no rows or columns are drawn."""
    return all(
        p.get("subsamplingRate", 1.0) == 1.0 and p.get("featureSubsetStrategy", "all") == "all" for p in points
    )


def cross_validate(
    algorithm: str,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    grid: Mapping[str, Sequence[Any]] | None = None,
    folds: int | None = None,
    parallelism: int | None = None,
    fold_col: str | None = None,
    key: str | Sequence[str] | None = None,
    seed: int = 1,
    handle_invalid: str = "error",
    method: str = "auto",
) -> TuningResult:
    """Mean RMSE of every grid point over the folds, and the refitted winner.

    Folds come from ``fold_col``, else from a hash of ``key`` (else of the whole
    row). ``method="rows"`` fits every grid point on the rows of every fold.
    """
    spec = SPECS[algorithm]
    folds, parallelism = folds or spec.folds, parallelism or spec.parallelism
    points = grid_points(algorithm, grid)
    if fold_col is None:
        fold_col = "fold"
        df = kfold(df, folds, key, seed, fold_col)
    rows = training_rows(df, features, label, handle_invalid)
    args = (rows, list(features), label, points, folds, parallelism, fold_col)
    ensure_checkpoint_dir(df.sparkSession)
    if method == "auto" and algorithm == "linear" and all(uses_moments(p, features) for p in points):
        means, best = _tune_linear(*args)
    elif method == "auto" and algorithm == "isotonic" and len({p.get("featureIndex", 0) for p in points}) == 1:
        means, best = _tune_isotonic(*args)
    elif method == "auto" and algorithm == "gbt" and _sequential_rounds(points):
        means, best = _tune_gbt(*args)
    elif method == "auto" and algorithm in ("decision_tree", "random_forest"):
        means, best = _tune_trees(algorithm, *args)
    else:
        means, best = _tune_rows(algorithm, rows, list(features), label, points, grid, folds, parallelism, fold_col)
    best.metrics["cv_rmse"] = float(np.min(means))
    return TuningResult(algorithm, label, points, [float(m) for m in means], best)


def model_comparison(models: Sequence[FittedModel], test: DataFrame) -> DataFrame:
    """(algorithm, label, params, rmse) of fitted models on one test part, best first."""
    errors = score_test(models, test)
    rows = [(m.algorithm, m.label, json.dumps(m.params, sort_keys=True), e) for m, e in zip(models, errors)]
    rows.sort(key=lambda r: (r[3], r[0], r[2]))
    return test.sparkSession.createDataFrame(rows, "algorithm string, label string, params string, rmse double")


def fit_all(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    params: Mapping[str, Mapping[str, Any]] | None = None,
    algorithms: Sequence[str] = tuple(SPECS),
) -> list[FittedModel]:
    """All regressors with given parameters on one training part."""
    return [fit_model(a, df, features, label, (params or {}).get(a)) for a in algorithms]

