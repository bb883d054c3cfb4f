"""Writers for readings and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_reading_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null fields stay in, since a null is the gap."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_raw_messages(df: DataFrame, path: str, value: str = "value", mode: str = "overwrite") -> None:
    """Messages as they came, byte by byte, whatever line ends or encodings they hold."""
    df.select(df[value].cast("binary").alias("value")).write.mode(mode).parquet(path)


def write_history(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Columnar copy of the history, for every later scan."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_history_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def preview(df: DataFrame, order_by: Sequence, n: int = 20) -> DataFrame:
    """The first rows in a stated order (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)
