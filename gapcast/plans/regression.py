"""One label, one history: profile, split, tune or load, predict, measure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.functions.calendar import calendar_features
from gapcast.operators.features import feature_columns
from gapcast.operators.metrics import rmse
from gapcast.operators.models import SPECS, TREES, FittedModel
from gapcast.operators.profile import describe_all
from gapcast.operators.quality import cast_label_double, labelled
from gapcast.operators.registry import ModelRegistry
from gapcast.operators.scoring import feature_importance, isotonic_steps, predict, predict_missing, tree_dump
from gapcast.operators.split import hash_split
from gapcast.operators.tuning import cross_validate, model_comparison
from gapcast.plans.correlation import CorrelationReport, correlation_report
from gapcast.schema import TIMESTAMP


@dataclass
class RegressionRun:
    fitted: FittedModel
    test_predictions: DataFrame
    new_predictions: DataFrame | None
    rmse: float
    importance: DataFrame | None = None
    steps: DataFrame | None = None
    rules: DataFrame | None = None
    unlabelled: DataFrame | None = None


@dataclass
class GapReport:
    correlation: CorrelationReport
    profile: DataFrame
    runs: dict[str, RegressionRun]
    comparison: DataFrame


def run_regression(
    history: DataFrame,
    label: str,
    algorithm: str,
    registry: ModelRegistry,
    new_readings: DataFrame | None = None,
    timestamp: str | None = TIMESTAMP,
    tz: str = "UTC",
    key: str | Sequence[str] | None = None,
    train: float = 0.7,
    seed: int = 0,
    grid: Mapping[str, Sequence[Any]] | None = None,
    retrain: bool = False,
    test_rmse: bool = True,
) -> RegressionRun:
    """Train the best model of a grid, or load it, and score test part and new readings.

    The split is by hash: a model loaded later is measured on the same test
    part, which it has never seen. A saved model of another split, zone or grid is
    refused unless ``retrain``. Rows whose label is no number take no part;
    ``unlabelled`` counts them.
    """
    if label == timestamp:
        raise ValueError("the timestamp is replaced by calendar features and cannot be the label")
    cast = cast_label_double(history, label)
    unlabelled = cast.agg((F.count("*") - F.count(F.when(~F.isnan(label), F.col(label)))).alias("n"))
    train_part, test_part = hash_split(labelled(cast, label), key, train, seed)
    if timestamp is not None:
        train_part, test_part = (calendar_features(p, timestamp, tz) for p in (train_part, test_part))
    features = feature_columns(train_part, label)

    def tune() -> FittedModel:
        return cross_validate(algorithm, train_part, features, label, grid, seed=seed + 1).best

    split = {
        "seed": seed,
        "key": [key] if isinstance(key, str) else list(key or ()),
        "train": train,
        "tz": tz if timestamp is not None else None,
        "grid": {k: list(v) for k, v in (grid or SPECS[algorithm].grid).items()},
    }
    fitted = registry.train_or_load(algorithm, label, features, tune, retrain, seed, split)
    scored = predict(fitted, test_part, keep_features=True).select("prediction", label, "features")

    new_scored = None
    if new_readings is not None:
        new = cast_label_double(new_readings, label)
        if timestamp is not None:
            new = calendar_features(new, timestamp, tz)
        new_scored = predict_missing(fitted, new)

    spark = history.sparkSession
    return RegressionRun(
        fitted,
        scored,
        new_scored,
        rmse(scored, label) if test_rmse else float("nan"),
        importance=feature_importance(spark, fitted) if algorithm in TREES else None,
        steps=isotonic_steps(spark, fitted) if algorithm == "isotonic" else None,
        rules=tree_dump(spark, fitted) if algorithm == "decision_tree" else None,
        unlabelled=unlabelled,
    )


def analyse_gap(
    history: DataFrame,
    label: str,
    registry: ModelRegistry,
    new_readings: DataFrame | None = None,
    algorithms: Sequence[str] = tuple(SPECS),
    grids: Mapping[str, Mapping[str, Sequence[Any]]] | None = None,
    timestamp: str | None = TIMESTAMP,
    tz: str = "UTC",
    key: str | Sequence[str] | None = None,
    train: float = 0.7,
    seed: int = 0,
    retrain: bool = False,
) -> GapReport:
    """Everything known about one missing field: correlations, and every regressor.

    All regressors share one split; their test errors come from one scan.
    """
    runs = {
        a: run_regression(
            history,
            label,
            a,
            registry,
            new_readings,
            timestamp,
            tz,
            key,
            train,
            seed,
            (grids or {}).get(a),
            retrain,
            test_rmse=False,
        )
        for a in algorithms
    }
    _, test_part = hash_split(labelled(cast_label_double(history, label), label), key, train, seed)
    table = history
    if timestamp is not None:
        test_part = calendar_features(test_part, timestamp, tz)
        table = calendar_features(history, timestamp, tz)
    comparison = model_comparison([r.fitted for r in runs.values()], test_part)
    for row in comparison.select("algorithm", F.col("rmse")).collect():  # one row per algorithm
        runs[row["algorithm"]].rmse = row["rmse"]
    return GapReport(
        correlation_report(history, label, timestamp, tz), describe_all(table), runs, comparison
    )
