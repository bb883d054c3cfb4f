"""Written tables and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.scratch import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stage(df: DataFrame, name: str, by: str | None = None, **options: object) -> DataFrame:
    """Write a frame to the shared folder, in a subfolder per value of ``by`` if given, and read it back.

    This cuts the lineage (an executor that is lost later costs no recomputation)
    and forgets the partitioning, so joins on the result are dealt by plain
    exchanges, whose large partitions adaptive execution can split. Options are
    the writer's; ``__`` stands for a dot.
    """
    path = shared_dir(df.sparkSession, name)
    writer = df.write.mode("overwrite").options(**{k.replace("__", "."): v for k, v in options.items()})
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(key: Column, n: int, rest: int) -> Column:
    """True where crc32 of the id as text, modulo n, is ``rest``; false for a null id."""
    remainder = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))
    return F.coalesce(remainder == rest, F.lit(False))


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings for the jobs run inside; ``__`` stands for a dot."""
    keys = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
