"""Apply models, fill gaps, look inside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.operators.features import FEATURES, assemble_features
from gapcast.operators.metrics import rmse_of_many
from gapcast.operators.models import FittedModel


def predict(
    fitted: FittedModel,
    df: DataFrame,
    prediction: str = "prediction",
    handle_invalid: str = "error",
    keep_features: bool = False,
) -> DataFrame:
    """Add the prediction, with the features in the order of the training table."""
    scored = fitted.model.transform(
        assemble_features(df, fitted.features, handle_invalid=handle_invalid),
        {fitted.model.predictionCol: prediction},
    )
    return scored if keep_features else scored.drop(FEATURES)


def predict_missing(
    fitted: FittedModel, df: DataFrame, prediction: str = "prediction", imputed: str = "imputed"
) -> DataFrame:
    """Fill the label where it is null; mark which rows were filled.

    Only these rows are scored: the prediction of the others is null. A row whose
    label and some feature are null or NaN cannot be filled; it goes on with a null
    label and ``imputed`` false.
    """
    label, types = fitted.label, dict(df.dtypes)
    gap = F.col(label).isNull()
    known = F.lit(True)
    for f in fitted.features:
        known = known & F.col(f).isNotNull()
        if types[f] in ("double", "float"):
            known = known & ~F.isnan(f)
    fill = gap & known
    # Features of rows that are not scored are made harmless for the assembler, then put back.
    stand_in = {f: F.when(fill, F.col(f)).otherwise(F.lit(0)).cast(types[f]) for f in fitted.features}
    kept = df.select(*[F.col(c) for c in df.columns], F.struct(*fitted.features).alias("own_features"), fill.alias(imputed))
    scored = predict(fitted, kept.withColumns(stand_in), prediction).withColumns(
        {f: F.col("own_features")[f] for f in fitted.features}
    )
    return scored.drop("own_features").withColumns(
        {
            prediction: F.when(F.col(imputed), F.col(prediction)),
            label: F.when(F.col(imputed), F.col(prediction)).otherwise(F.col(label)),
        }
    )


def model_names(models: Sequence[FittedModel]) -> list[str]:
    """The algorithm of each model; further models of an algorithm get a number (``linear_2``)."""
    names: list[str] = []
    for m in models:
        earlier = sum(other.algorithm == m.algorithm for other in models[: len(names)])
        names.append(f"{m.algorithm}_{earlier + 1}" if earlier else m.algorithm)
    return names


def score_test(models: Sequence[FittedModel], test: DataFrame) -> list[float]:
    """Test RMSE of several models of one label, in their order, in one scan."""
    scored, columns = test, {}
    for i, m in enumerate(models):
        columns[f"m{i}"] = f"prediction_{i}"
        scored = predict(m, scored, columns[f"m{i}"])
    found = rmse_of_many(scored, models[0].label, columns)
    return [found[f"m{i}"] for i in range(len(models))]


def feature_importance(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """(feature, importance) of a tree model, in feature order."""
    values: Mapping[int, float] = fitted.model.featureImportances
    rows = [(i, f, float(values[i])) for i, f in enumerate(fitted.features)]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


def tree_dump(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """The learned rules as text lines, features by name."""
    lines = fitted.model.toDebugString.rstrip("\n").split("\n")
    names = {f"feature {i} ": f"{f} " for i, f in enumerate(fitted.features)}
    for key in sorted(names, key=len, reverse=True):
        lines = [line.replace(key, names[key]) for line in lines]
    return spark.createDataFrame(list(enumerate(lines)), "line int, rule string")


def isotonic_steps(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """Boundaries and the predictions that go with them, in increasing order."""
    model = fitted.model
    pairs = zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist())
    rows = [(i, b, p) for i, (b, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "step int, boundary double, prediction double")
