"""Errors of a scored table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse_column(label: str, prediction: str = "prediction"):
    return F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), 2)))


def r2_column(label: str, prediction: str = "prediction"):
    """Null where the label does not vary. Rows without a label or a prediction do not count."""
    known = F.when(F.col(prediction).isNotNull(), F.col(label))
    error = F.sum(F.pow(F.col(label) - F.col(prediction), 2))
    return 1 - F.try_divide(error, F.var_pop(known) * F.count(known))


def regression_metrics(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Rows with label and prediction, root mean squared error and r2, in one aggregate."""
    return scored.agg(
        F.count(F.when(F.col(prediction).isNotNull(), F.col(label))).alias("n"),
        rmse_column(label, prediction).alias("rmse"),
        r2_column(label, prediction).alias("r2"),
    )


def rmse(scored: DataFrame, label: str, prediction: str = "prediction") -> float:
    return scored.agg(rmse_column(label, prediction).alias("rmse")).first()["rmse"]


def rmse_of_many(scored: DataFrame, label: str, predictions: Mapping[str, str]) -> dict[str, float]:
    """RMSE of several prediction columns in one scan."""
    row = scored.agg(*[rmse_column(label, c).alias(k) for k, c in predictions.items()]).first()
    return row.asDict()
