"""Which fields of a raw JSON reading are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, next to JSON null.
MISSING_TEXTS = ("", "undefined")


def is_missing(value: Column) -> Column:
    return value.isNull() | value.isin(*MISSING_TEXTS)


def last_of_each_key(parsed: Column) -> Column:
    """A parsed JSON object in which a repeated key counts with its last value.

    Keys stay in payload order, a repeated one at its first position. The map is
    used as it is when no key repeats.
    """
    keys = F.array_distinct(F.map_keys(parsed))

    def last_value(key: Column) -> Column:
        same = F.filter(F.map_entries(parsed), lambda e: e["key"] == key)
        return F.element_at(same, -1)["value"]

    return F.when(F.size(keys) == F.size(parsed), parsed).otherwise(
        F.map_from_arrays(keys, F.transform(keys, last_value))
    )


def missing_fields(payload: Column, expected_fields: Sequence[str] | None = None) -> Column:
    """Missing keys in payload order; then absent ones, if fields are expected."""
    gaps = F.transform(
        F.filter(F.map_entries(payload), lambda e: is_missing(e["value"])), lambda e: e["key"]
    )
    if not expected_fields:
        return gaps
    expected = F.array(*[F.lit(f) for f in expected_fields])
    return F.concat(gaps, F.array_except(expected, F.map_keys(payload)))


def first_missing(missing: Column) -> Column:
    """The field to predict, or null when nothing is missing."""
    return F.get(missing, F.lit(0))
