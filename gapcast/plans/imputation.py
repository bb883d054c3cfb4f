"""Fill the gaps of a table of messages: decode, detect, route, score by label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.functions.calendar import CALENDAR_COLUMNS, calendar_columns
from gapcast.operators.flat_models import predict_by_key
from gapcast.operators.models import FittedModel
from gapcast.operators.quality import COMPLETE, IMPUTE, REJECT, detect_missing, route_readings
from gapcast.operators.scoring import model_names
from gapcast.schema import TIMESTAMP, reading_schema
from gapcast.scratch import shared_dir
from gapcast.sources.messages import decode_message, once, typed_fields

Models = Mapping[str, Sequence[FittedModel]]

# Partition column of staged readings: the label to fill, null for the rest.
FILL = "fill"


def route_messages(
    messages: DataFrame,
    schema: T.StructType | None = None,
    timestamp: str = TIMESTAMP,
    value: str = "value",
    expected_fields: Sequence[str] | None = None,
    several_missing: str = "reject",
) -> DataFrame:
    """Messages with payload, missing fields, label, route, reason and typed fields.

    Projections only: one parse per message, nothing is shuffled.
    """
    schema = schema or reading_schema()
    fields = [n for n in schema.names if n != timestamp]
    decoded = decode_message(messages, value)
    routed = route_readings(
        detect_missing(decoded, expected_fields=expected_fields),
        fields,
        timestamp,
        several_missing=several_missing,
    )
    return typed_fields(routed, schema)


def _with_model_check(routed: DataFrame, models: Models, fields: Sequence[str]) -> DataFrame:
    """Turn away readings that no model can fill."""
    gap = F.col("route") == IMPUTE
    reason = F.when(gap & ~F.col("label").isin(*models), "no_model")
    for label, fitted in models.items():
        needed = sorted({f for m in fitted for f in m.features if f in fields})
        if needed:
            empty: Column = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in needed])
            reason = reason.when(gap & (F.col("label") == label) & empty, "feature_missing")
    return routed.withColumn("reason", F.coalesce("reason", reason)).withColumn(
        "route", F.when(F.col("reason").isNotNull(), REJECT).otherwise(F.col("route"))
    )


def stage_by_label(routed: DataFrame, path: str) -> DataFrame:
    """Write routed readings once and read them back, one folder per label to fill.

    Training and scoring then read typed columns of the folders they need, where
    they would parse all messages again. Only routable labels make folders, so
    there are few.
    """
    keyed = routed.withColumn(FILL, F.when(F.col("route") == IMPUTE, F.col("label")))
    keyed.write.mode("overwrite").partitionBy(FILL).parquet(path)
    return routed.sparkSession.read.schema(keyed.schema).parquet(path)


def complete_readings(routed: DataFrame, needed: Sequence[str] = ()) -> DataFrame:
    """The readings without a gap, for training: of these, the ones that have all ``needed`` fields."""
    rows = routed.filter(F.col("route") == COMPLETE)
    if needed:
        rows = rows.dropna(subset=list(needed))
    return rows.filter(F.col(FILL).isNull()).drop(FILL) if FILL in routed.columns else rows


def score_by_label(
    routed: DataFrame,
    models: Models,
    schema: T.StructType | None = None,
    timestamp: str = TIMESTAMP,
    tz: str = "UTC",
) -> tuple[DataFrame, DataFrame]:
    """(filled readings, rejects). The label of a reading picks its models.

    Per label the first model fills the gap; ``predictions`` holds the values of
    all of its models. Complete readings pass through. One pass scores all labels:
    flat forms of the models are sent along once, and each batch of readings is
    dealt to the models of their labels. Only label and features go to Python.
    """
    schema = schema or reading_schema()
    checked = _with_model_check(routed, models, schema.names)
    if FILL in checked.columns:
        checked = checked.drop(FILL)
    gap = F.col("route") == IMPUTE
    filled = checked.filter(F.col("route") != REJECT).withColumn("imputed", gap)
    if models:
        filled = filled.withColumns(calendar_columns(F.col(timestamp), tz))
        found = predict_by_key(routed.sparkSession, models, F.when(gap, F.col("label")))
        filled = once(filled, found=found).drop(*[c for c in CALENDAR_COLUMNS if c not in routed.columns])
    else:
        filled = filled.withColumn("found", F.lit(None).cast("array<double>"))
    names = F.lit(None).cast("array<string>")
    for label, fitted in models.items():
        names = F.when(F.col("label") == label, F.array(*map(F.lit, model_names(fitted)))).otherwise(names)
    filled = filled.withColumns({"prediction": F.get("found", F.lit(0)), "predictions": F.map_from_arrays(names, "found")})
    values = {n: F.when(gap & (F.col("label") == n), F.col("prediction")).otherwise(F.col(n)) for n in models}
    return (
        filled.withColumns(values).drop("payload", "missing", "route", "reason", "found"),
        checked.filter(F.col("route") == REJECT),
    )


def impute_messages(
    messages: DataFrame,
    models: Models,
    schema: T.StructType | None = None,
    timestamp: str = TIMESTAMP,
    value: str = "value",
    tz: str = "UTC",
    expected_fields: Sequence[str] | None = None,
    several_missing: str = "reject",
    staging_dir: str | None = "auto",
) -> tuple[DataFrame, DataFrame]:
    """(filled readings, rejects) of a batch of raw messages.

    With models for several labels the routed readings are staged (see
    :func:`stage_by_label`), by default in the cluster's shared folder; with
    None the filled readings and the rejects each parse the messages.
    """
    routed = route_messages(messages, schema, timestamp, value, expected_fields, several_missing)
    if staging_dir == "auto":
        staging_dir = shared_dir(messages.sparkSession, "staged") if len(models) > 1 else None
    if staging_dir is not None:
        routed = stage_by_label(routed, staging_dir)
    return score_by_label(routed, models, schema, timestamp, tz)
