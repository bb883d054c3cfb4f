"""Kafka as a streaming source of readings (needs Spark's Kafka connector jar)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def kafka_options(
    servers: str,
    topic: str,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return {**options, **(extra or {})}


def read_stream_kafka(spark: SparkSession, servers: str, topic: str, **kwargs) -> DataFrame:
    """Message stream with a binary ``value`` column.

    ``startingOffsets`` counts on the first start only; afterwards the query's
    checkpoint says where to go on, so no reading is lost while models run.
    """
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **kwargs)).load()


def read_stream_raw(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same binary ``value`` column from a folder that ``write_raw_messages`` filled."""
    reader = spark.readStream.schema("value binary")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def read_stream_text(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same ``value`` column from a folder of line-JSON files."""
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)
