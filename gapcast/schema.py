"""The reading table: twelve flat fields, one of them an epoch in milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TIMESTAMP = "timestamp"

# The fields of a reading.
SENSOR_FIELDS = (
    "humidity",
    "light",
    "pm10",
    "pm2_5",
    "pressure",
    "rain",
    "temperature",
    "wind_dir",
    "wind_dir_degrees",
    "wind_force",
    "wind_speed",
)


def reading_schema(fields: Sequence[str] = SENSOR_FIELDS, timestamp: str = TIMESTAMP) -> T.StructType:
    """Explicit schema, so that no read needs an inference pass."""
    return T.StructType(
        [T.StructField(timestamp, T.LongType())] + [T.StructField(f, T.DoubleType()) for f in fields]
    )


def numeric_columns(df: DataFrame, strict_types: bool = False) -> list[str]:
    """Columns with a numeric type, in table order.

    ``strict_types`` keeps only double and int, the narrow rule under which a
    bigint column is left out.
    """
    if strict_types:
        return [name for name, dtype in df.dtypes if dtype in ("double", "int")]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    """Columns profiled by frequency: text and flags."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def date_columns(df: DataFrame) -> list[str]:
    """Dates and timestamps, in table order."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
