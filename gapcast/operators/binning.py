"""Histograms and pairwise densities: the numbers behind a scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.operators.quantiles import ColumnRange, cells, column_ranges, lookup, number
from gapcast.operators.split import sample_fraction
from gapcast.schema import numeric_columns


def _bin_index(value: Column, place: Column, ranges: Sequence[ColumnRange], bins: int) -> Column:
    """Equal-width bin between a column's minimum and maximum; the last bin is closed.

    All values of a constant column are in the middle bin, infinite ones in the end bins.
    """
    low = lookup([r.low for r in ranges], place)
    high = lookup([r.high for r in ranges], place)
    share = F.when(high > low, (value / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))).otherwise(0.5)
    inner = F.least((F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * bins).cast("long"), F.lit(bins - 1))
    ends = F.when(value == float("inf"), F.lit(bins - 1)).when(value == float("-inf"), F.lit(0))
    return F.when(value.isNotNull(), ends.otherwise(inner).cast("long"))


def finite_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnRange]:
    """Ranges of the finite values; infinite ones are counted in the end bins."""
    types = dict(df.dtypes)
    finite = {}
    for c in columns:
        value = number(c, types[c])
        finite[c] = F.when(F.abs(value) < float("inf"), value) if types[c] in ("double", "float") else value
    return column_ranges(df.select(*[v.alias(c) for c, v in finite.items()]), columns)


def _edge(bounds: ColumnRange, i: Column, bins: int) -> Column:
    """Lower edge of bin ``i``; a constant column gets a range of width one."""
    low, high = bounds.low, bounds.high
    if low == high:
        low, high = low - 0.5, high + 0.5
    return F.lit(low) + i * (high - low) / bins


def _by_code(column: Column, values: Sequence[Column]) -> Column:
    """Pick ``values[column]``, all of them literals or expressions of the row."""
    return F.element_at(F.array(*values), column.cast("int") + 1)


def _prepare(df, columns, ranges, fraction, seed):
    columns = list(columns) if columns is not None else numeric_columns(df)
    if fraction is not None:
        df = sample_fraction(df, fraction, seed)
    ranges = ranges or finite_ranges(df, columns)
    return df, columns, ranges


def histograms(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = 10,
    ranges: Mapping[str, ColumnRange] | None = None,
    fraction: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Counts per equal-width bin of every column, empty bins included.

    Every value becomes one integer code of column and bin; codes are counted
    before the shuffle, which then carries columns x bins groups per task at most.
    """
    df, columns, ranges = _prepare(df, columns, ranges, fraction, seed)
    columns = [c for c in columns if ranges[c].low is not None]
    place = F.col("c")
    bin_index = _bin_index(F.col("v"), place, [ranges[c] for c in columns], bins)
    counts = (
        cells(df, columns)
        .select((place.cast("long") * bins + bin_index).alias("code"))
        .groupBy("code")
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(len(columns) * bins).select(F.col("id").alias("code"))
    which, b = F.expr(f"code div {bins}"), (F.col("code") % bins).cast("int")
    return grid.join(counts, "code", "left").select(
        _by_code(which, [F.lit(c) for c in columns]).alias("column"),
        b.alias("bin"),
        _by_code(which, [_edge(ranges[c], b, bins) for c in columns]).alias("bin_low"),
        _by_code(which, [_edge(ranges[c], b + 1, bins) for c in columns]).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# Cells of the count array a task keeps; beyond it, counts are given out batch by batch.
DENSE_CELLS = 4_000_000


def bin_numbers(values: np.ndarray, bounds: ColumnRange, bins: int) -> np.ndarray:
    """The bins of ``_bin_index`` for an array of values; -1 for NaN."""
    if bounds.low is None:  # no finite value: infinite ones go to the end bins all the same
        share = np.full(len(values), 0.5)
    else:
        low, width = bounds.low / 2, bounds.high / 2 - bounds.low / 2
        share = (values / 2 - low) / width if width > 0 else np.full(len(values), 0.5)
    inner = np.minimum((np.clip(np.nan_to_num(share), 0.0, 1.0) * bins).astype(np.int64), bins - 1)
    inner = np.where(values == np.inf, bins - 1, np.where(values == -np.inf, 0, inner))
    return np.where(np.isnan(values), -1, inner)


def _pair_codes(df: DataFrame, columns: Sequence[str], bounds: Sequence[ColumnRange], bins: int) -> DataFrame:
    """(code, n): counts per pair of columns and cell, one row per task and cell that holds a row.

    A task adds the cells of whole batches to one dense array: codes are never rows.
    """
    size, grid = len(columns), bins * bins
    pairs = [(x, y) for x in range(size) for y in range(x + 1, size)]
    dense = len(pairs) * grid <= DENSE_CELLS
    types = dict(df.dtypes)
    values = df.select(*[number(c, types[c]).alias(f"v{i}") for i, c in enumerate(columns)])

    def out(place: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        x, y = pairs[place]
        return pa.RecordBatch.from_arrays([pa.array((x * size + y) * grid + cell, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(pairs), grid), np.int64) if dense else None
        for batch in batches:
            with np.errstate(invalid="ignore", over="ignore"):
                binned = [bin_numbers(batch.column(i).to_numpy(zero_copy_only=False).astype(float), bounds[i], bins) for i in range(size)]
            gaps = [(b < 0).any() for b in binned]
            for place, (x, y) in enumerate(pairs):
                cell = binned[x] * bins + binned[y]
                if gaps[x] or gaps[y]:
                    cell = cell[(binned[x] >= 0) & (binned[y] >= 0)]
                if dense:
                    counts[place] += np.bincount(cell, minlength=grid)
                else:
                    yield out(place, *np.unique(cell, return_counts=True))
        for place in range(len(pairs) if dense else 0):
            held = np.flatnonzero(counts[place])
            yield out(place, held, counts[place][held])

    return values.mapInArrow(run, "code bigint, n bigint")


def scatter_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = 10,
    ranges: Mapping[str, ColumnRange] | None = None,
    fraction: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Counts per cell of a bins x bins grid, for every pair of columns.

    A scatter matrix without its points: all pairs come from one scan, counted in
    one array per task before the shuffle. Cells without rows are left out, and
    rows where one of the two values is missing.
    """
    df, columns, ranges = _prepare(df, columns, ranges, fraction, seed)
    counted = _pair_codes(df, columns, [ranges[c] for c in columns], bins)
    counts = counted.groupBy("code").agg(F.sum("n").alias("n"))
    code, names = F.col("code"), [F.lit(c) for c in columns]
    pair = F.expr(f"code div {bins * bins}")
    return counts.select(
        _by_code(F.expr(f"code div {bins * bins * len(columns)}"), names).alias("x"),
        _by_code(pair % len(columns), names).alias("y"),
        (F.expr(f"code div {bins}") % bins).cast("int").alias("x_bin"),
        (code % bins).cast("int").alias("y_bin"),
        "n",
    )
