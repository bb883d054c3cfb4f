"""Detect gaps, route readings, clean the label column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.functions.missing import first_missing, is_missing, missing_fields
from gapcast.schema import SENSOR_FIELDS, TIMESTAMP
from gapcast.sources.messages import once

COMPLETE, IMPUTE, REJECT = "complete", "impute", "reject"


def detect_missing(
    df: DataFrame, payload: str = "payload", expected_fields: Sequence[str] | None = None
) -> DataFrame:
    """Add ``missing`` (all missing fields, payload order) and ``label`` (the first)."""
    found = once(df, missing=missing_fields(F.col(payload), expected_fields))
    return found.withColumn("label", first_missing(F.col("missing")))


def is_number(text: Column, kind: str) -> Column:
    """True where a text converts to a finite number; texts such as NaN and Infinity do not count."""
    value = text.try_cast(kind)
    finite = value.isNotNull() if kind == "long" else F.abs(value) < float("inf")  # NaN is above infinity
    return F.coalesce(finite, F.lit(False))


def route_readings(
    df: DataFrame,
    fields: Sequence[str] = SENSOR_FIELDS,
    timestamp: str = TIMESTAMP,
    payload: str = "payload",
    several_missing: str = "reject",
) -> DataFrame:
    """Add ``route`` (complete, impute or reject) and, for rejects, a ``reason``.

    Expects the columns of :func:`detect_missing`. With
    ``several_missing="first"`` a reading with more than one gap goes on with
    its first one as label; its other gaps stay null. Texts that are no finite
    number (``NaN`` and ``Infinity`` too) are ``not_numeric``.
    """
    raw, label = F.col(payload), F.col("label")
    inputs = [timestamp, *fields]
    # Tests of all fields in loops over arrays: spelled out per field they took longer.
    texts = F.array(*[F.struct(F.lit(f).alias("name"), raw[f].alias("text"), F.lit(f == timestamp).alias("whole")) for f in inputs])

    def other(name: Column) -> Column:
        return label.isNull() | (label != name)

    def no_number(field: Column) -> Column:
        text = field["text"]
        number = F.when(field["whole"], is_number(text, "long")).otherwise(is_number(text, "double"))
        return other(field["name"]) & ~is_missing(text) & ~number

    not_numeric = F.exists(texts, no_number)
    absent = F.exists(F.array(*map(F.lit, inputs)), lambda f: other(f) & ~F.array_contains(F.map_keys(raw), f))
    has_gap = F.size("missing") > 0

    reason = F.when(raw.isNull(), "bad_json")
    if several_missing == "reject":
        reason = reason.when(F.size("missing") > 1, "several_missing")
    reason = (
        reason.when(F.array_contains("missing", timestamp), "timestamp_missing")
        .when(has_gap & ~F.col("label").isin(*fields), "unknown_field")
        .when(not_numeric, "not_numeric")
        .when(has_gap & absent, "absent_field")
    )
    known = once(df.withColumn("has_gap", has_gap), reason=reason)
    route = F.when(F.col("reason").isNotNull(), REJECT).when(F.col("has_gap"), IMPUTE).otherwise(COMPLETE)
    return known.withColumn("route", route).drop("has_gap")


def collect_bad_input(routed: DataFrame) -> DataFrame:
    """The rejected readings with their reason; nothing is swallowed."""
    return routed.filter(F.col("route") == REJECT)


def cast_label_double(df: DataFrame, label: str) -> DataFrame:
    """Text labels become double; texts that are no number become null."""
    return df.withColumn(label, F.col(label).try_cast("double"))


def fill_label(df: DataFrame, label: str, value: float = 0.0) -> DataFrame:
    """Fill the label, and only the label."""
    return df.na.fill(value, [label])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows a model can learn from: the label is a real number."""
    known = F.col(label).isNotNull()
    if dict(df.dtypes)[label] in ("double", "float"):
        known = known & ~F.isnan(label)
    return df.filter(known)
