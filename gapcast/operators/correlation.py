"""Correlation of every column with the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.operators.quantiles import lookup
from gapcast.schema import numeric_columns


def corr_with_label(
    df: DataFrame, label: str, columns: Sequence[str] | None = None, nulls: str = "zero"
) -> DataFrame:
    """Pearson correlation of the label with each numeric column, the label too.

    One scan and one aggregate, with a row per column and task. ``nulls="zero"``
    counts a null as 0.0 on both sides, as ``df.stat.corr`` does; ``nulls="drop"``
    leaves the pair out. The value of a constant column is null.
    """
    if nulls not in ("zero", "drop"):
        raise ValueError("nulls must be 'zero' or 'drop'")
    columns = list(columns) if columns is not None else numeric_columns(df)

    def value(name: str):
        v = F.col(name).cast("double")
        return F.coalesce(v, F.lit(0.0)) if nulls == "zero" else v

    y, v = F.col("y"), F.col("v")
    pairs = (
        df.select(value(label).alias("y"), F.posexplode(F.array(*map(value, columns))).alias("c", "v"))
        .filter(y.isNotNull() & v.isNotNull())
        .groupBy("c")
        # a constant column has no correlation: null rather than a division by zero
        .agg(F.try_divide(F.covar_pop(y, v), F.stddev_pop(y) * F.stddev_pop(v)).alias("corr"))
    )
    places = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("c"))
    return places.join(pairs, "c", "left").select(lookup(columns, F.col("c"), "string").alias("column"), "corr")
