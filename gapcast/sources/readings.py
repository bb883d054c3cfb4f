"""Readers for reading history and new readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.schema import reading_schema


def read_history_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    infer: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """Reading history from CSV with a header, columns in file order.

    Types come from ``schema`` by column name; the header alone is read first
    to learn the order, so there is no inference pass over the data. A column
    the schema does not name stays text. ``infer`` asks for the full pass. With
    ``corrupt`` a column of that name keeps the text of every line that does not
    convert (see :func:`split_corrupt`); it is null for good lines.
    """
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    known = {f.name: f for f in (schema or reading_schema()).fields}
    header = reader.csv(path).columns
    fields = [known.get(name, T.StructField(name, T.StringType())) for name in header]
    if corrupt is not None:
        fields.append(T.StructField(corrupt, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(T.StructType(fields)).option("enforceSchema", corrupt is not None).csv(path)


def read_history_parquet(spark: SparkSession, path: str) -> DataFrame:
    """History converted once by ``write_history``: columnar, pruned, typed."""
    return spark.read.parquet(path)


def read_reading_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multiline: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """New readings, one JSON object per line, or pretty-printed with ``multiline``.

    With ``corrupt`` a column of that name keeps the text of every record that
    does not convert; it is null for good records.
    """
    schema, reader = schema or reading_schema(), spark.read.option("multiLine", multiline)
    if corrupt is not None:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)


def split_corrupt(readings: DataFrame, corrupt: str) -> tuple[DataFrame, DataFrame]:
    """(good readings, rejects): rejects hold the corrupt text and ``reason``, as rejected messages do."""
    fields = [c for c in readings.columns if c != corrupt]
    # Always true: makes every query read the fields too, without which Spark does not tell a corrupt record.
    whole = F.hash(*fields).between(-(2**31), 2**31 - 1)
    good = readings.filter(F.col(corrupt).isNull() & whole).drop(corrupt)
    bad = readings.filter(F.col(corrupt).isNotNull() & whole)
    return good, bad.select(F.col(corrupt).alias("value"), F.lit("bad_record").alias("reason"))


def read_messages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Raw JSON messages as a ``value`` column, as a message stream carries them."""
    return spark.read.text(path, wholetext=multiline)
