"""From message bytes to a raw payload and typed fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.functions.missing import last_of_each_key
from gapcast.schema import reading_schema


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that a later filter on them does not repeat them.

    The optimizer pushes filters below a plain projection by copying its
    expressions into the condition; it does not push them below a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def decode_message(df: DataFrame, value: str = "value", payload: str = "payload") -> DataFrame:
    """Add the ordered key-value map of a UTF-8 JSON object.

    It is null for bytes that are not UTF-8, for broken JSON and for JSON that
    is not an object.
    """
    text = F.try_validate_utf8(F.col(value).cast("string"))
    parsed = once(df, parsed_payload=F.from_json(text, "map<string,string>"))
    return parsed.withColumn(payload, last_of_each_key(F.col("parsed_payload"))).drop("parsed_payload")


def typed_fields(
    df: DataFrame,
    schema: T.StructType | None = None,
    payload: str = "payload",
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Add one typed column per field; null where the text does not convert."""
    schema = schema or reading_schema()
    chosen = [f for f in schema.fields if fields is None or f.name in fields]
    return df.withColumns(
        {f.name: F.col(payload)[f.name].try_cast(f.dataType) for f in chosen}
    )
