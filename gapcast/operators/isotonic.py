"""Isotonic regression on any number of points: pool adjacent violators, distributed.

A range of points reduces to level stretches of rising means, and so do two
neighbouring ranges together: only the stretches of the left one that are not
below the first of the right one, and those of the right one that are not above
the last of the left one, can still be pooled. So ranges are reduced by
themselves, then merged in pairs, and a merge moves only the stretches near the
border. What is left at the end are the steps of the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.scratch import shared_dir

# Points that one task reduces, about. Fewer than this in all need no reduction.
RANGE_POINTS = 200_000
BLOCK = "part long, low double, high double, weight double, total double"
NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches (part, low, high, weight, total) in order, pooled within each part while a mean is not above the one before."""
    part, stack = None, []

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(stack), 65536):
            columns = list(zip(*stack[i : i + 65536]))
            arrays = [pa.array([part] * len(columns[0]), pa.int64()), *[pa.array(c, pa.float64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)

    for batch in batches:
        for own, low, high, weight, total in zip(*(c.to_pylist() for c in batch.columns)):
            if own != part:
                yield from out()
                part, stack = own, []
            while stack and stack[-1][3] * weight >= total * stack[-1][2]:  # mean before >= mean here
                before = stack.pop()
                low, weight, total = before[0], weight + before[2], total + before[3]
            stack.append((low, high, weight, total))
    yield from out()


def _merged(blocks: DataFrame) -> DataFrame:
    """Parts 2i and 2i + 1 become part i."""
    pair, left, mean = F.shiftright("part", 1), F.col("part") % 2 == 0, F.col("total") / F.col("weight")
    border = blocks.groupBy(pair.alias("pair")).agg(
        F.max(F.when(left, mean)).alias("left_last"), F.min(F.when(~left, mean)).alias("right_first")
    )
    paired = blocks.withColumn("pair", pair).join(F.broadcast(border), "pair")  # one row per two ranges of RANGE_POINTS points
    open_ = F.when(left, mean >= F.col("right_first")).otherwise(mean <= F.col("left_last"))
    paired = paired.withColumn("open", F.coalesce(open_, F.lit(False)))
    columns = [F.col("pair").alias("part"), *NAMES[1:]]
    pooled = paired.where("open").select(*columns).repartition("part").sortWithinPartitions("part", "low").mapInArrow(_pool, BLOCK)
    return paired.where("NOT open").select(*columns).unionByName(pooled)


def isotonic_steps_of(
    points: DataFrame, x: str, y: str, weight: str, increasing: bool = True, range_points: int = RANGE_POINTS, n: int | None = None
) -> DataFrame:
    """(low, high, weight, mean): the level stretches of the isotonic fit to weighted points with distinct ``x``.

    Means rise strictly with x, or fall if not ``increasing``.
    """
    sign = 1.0 if increasing else -1.0
    ranges = max(1, -(-(n if n is not None else points.count()) // range_points))
    single = points.select(
        F.col(x).alias("low"), F.col(x).alias("high"), F.col(weight).alias("weight"), (F.lit(sign) * F.col(y) * F.col(weight)).alias("total")
    )
    dealt = single.repartitionByRange(ranges, "low").withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions("low")
    blocks = _staged(dealt.select(*NAMES).mapInArrow(_pool, BLOCK), "isotonic-blocks")
    while ranges > 1:
        blocks = _staged(_merged(blocks), "isotonic-blocks")
        ranges = -(-ranges // 2)
    return blocks.select("low", "high", "weight", (F.lit(sign) * F.col("total") / F.col("weight")).alias("mean"))


def condensed(points: DataFrame, x: str, y: str, weight: str, increasing: bool, n: int | None = None, range_points: int = RANGE_POINTS) -> DataFrame:
    """Points (x, y, weight) that have the same isotonic fit: both ends of each level stretch."""
    if (n if n is not None else points.count()) <= range_points:
        return points.select(x, y, weight).coalesce(1)  # few: one task, and sums in one order
    steps = isotonic_steps_of(points, x, y, weight, increasing, range_points, n)
    half = F.when(F.col("low") < F.col("high"), F.col("weight") / 2).otherwise(F.col("weight"))
    ends = F.array_distinct(F.array("low", "high"))
    return steps.select(F.explode(ends).alias(x), F.col("mean").alias(y), half.alias(weight))
