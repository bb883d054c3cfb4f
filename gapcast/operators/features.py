"""Feature lists and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

FEATURES = "features"


def feature_columns(df: DataFrame, label: str) -> list[str]:
    """Every column but the label, in table order."""
    names = list(df.columns)
    names.remove(label)
    return names


def assemble_features(
    df: DataFrame, features: Sequence[str], output: str = FEATURES, handle_invalid: str = "error"
) -> DataFrame:
    """Add the feature vector. A null or text input raises unless told to skip or keep."""
    return VectorAssembler(
        inputCols=list(features), outputCol=output, handleInvalid=handle_invalid
    ).transform(df)
