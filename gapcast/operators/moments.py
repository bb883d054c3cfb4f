"""Second moments of a table, and least squares from them.

A least-squares fit with any elastic-net penalty sees the rows only through
their count, means and covariances. These are gathered for all folds in one
scan; each of the many fits of a grid then runs on a handful of weighted points
with the same moments instead of on the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.operators.quantiles import number

# A task holds a Gram matrix per fold, eight megabytes at this many columns; so does the driver in the end.
MAX_COLUMNS = 1024
# Columns of a tile: what is sent and added is the part of a matrix that two blocks of columns make.
TILE = 64


@dataclass(frozen=True)
class Moments:
    n: float
    mean: np.ndarray
    scatter: np.ndarray  # centred sums of products

    def __add__(self, other: Moments) -> Moments:
        if self.n == 0 or other.n == 0:
            return other if self.n == 0 else self
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * (other.n / n),
            self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n),
        )


def _tiles(width: int) -> list[tuple[int, int]]:
    """Pairs of column blocks on and above the diagonal."""
    starts = range(0, width, TILE)
    return [(a, b) for a in starts for b in starts if a <= b]


def _matrix(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _partial_grams(mean: np.ndarray):
    """Per task and fold: sums of products of (1, columns less their means), in tiles."""
    width = len(mean)
    tiles = _tiles(width + 1)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.column_stack([np.ones(len(key)), _matrix(batch, 1, width) - mean])
            for k in np.unique(key):
                part = rows[key == k]
                grams[int(k)] = grams.get(int(k), 0.0) + part.T @ part
        for k, gram in grams.items():
            cells = [gram[a : a + TILE, b : b + TILE].ravel() for a, b in tiles]
            columns = [pa.array([k] * len(tiles), pa.int32()), pa.array(range(len(tiles)), pa.int32()), pa.array(cells, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "tile", "cells"])

    return gather


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tiles that an exchange brought together, one row per fold and tile."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for key, tile, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            values = cells.values.to_numpy()
            sums[key, tile] = sums[key, tile] + values if (key, tile) in sums else values.copy()
    columns = [pa.array([k for k, _ in sums], pa.int32()), pa.array([t for _, t in sums], pa.int32())]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.list_(pa.float64()))], ["key", "tile", "cells"])


def _means(values: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and per column the number of values and their mean."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known, total = 0, np.zeros(width, np.int64), np.zeros(width)
        for batch in batches:
            x = _matrix(batch, 0, width)
            rows += len(x)
            known += (~np.isnan(x)).sum(axis=0)
            total += np.nansum(x, axis=0)
        columns = [pa.array(range(width), pa.int32()), pa.array([rows] * width, pa.int64()), pa.array(known), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "rows", "known", "total"])

    parts = values.mapInArrow(gather, "i int, rows long, known long, total double").groupBy("i")
    found = parts.agg(*[F.sum(c).alias(c) for c in ("rows", "known", "total")]).orderBy("i").collect()  # a row per column
    known = np.array([r["known"] for r in found] or [0] * width)
    return (found[0]["rows"] if found else 0), known, np.array([r["total"] for r in found] or [0.0] * width) / np.maximum(known, 1)


def collect_moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict[int, Moments]:
    """Moments of ``columns`` per value of the integer column ``by`` (else key 0).

    Two scans. The first finds the means, which the second subtracts: the sums of
    products then lose no digits to large means. Each task sends the tiles of one
    matrix per key; a tile is added up in one place, whatever the number of tasks.
    """
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"{len(columns)} columns: fit on the rows instead (method='rows')")
    types, width = dict(df.dtypes), len(columns)
    values = df.select(
        (F.lit(0) if by is None else F.col(by)).cast("int").alias("key"), F.array(*[number(c, types[c]) for c in columns]).alias("x")
    )
    n, known, mean = _means(values.select("x"), width)
    if short := [c for c, k in zip(columns, known) if k < n]:
        raise ValueError(f"null or NaN values in {short}")
    if n == 0:
        return {}
    parts = values.mapInArrow(_partial_grams(mean), "key int, tile int, cells array<double>")
    sums = parts.repartition("key", "tile").mapInArrow(_added, "key int, tile int, cells array<double>").collect()  # keys x columns^2 / 2 numbers
    tiles, grams = _tiles(width + 1), {}
    for r in sums:
        g = grams.setdefault(r["key"], np.zeros((width + 1, width + 1)))
        a, b = tiles[r["tile"]]
        block = g[a : a + TILE, b : b + TILE]
        block[:] = np.reshape(r["cells"], block.shape)
    result = {}
    for k, g in sorted(grams.items()):
        g = np.triu(g) + np.triu(g, 1).T
        count, offset = g[0, 0], g[0, 1:] / g[0, 0]
        result[k] = Moments(count, mean + offset, g[1:, 1:] - count * np.outer(offset, offset))
    return result


def points_with_moments(spark: SparkSession, m: Moments, label: str, features_col: str, weight: str) -> DataFrame:
    """A few weighted points whose count, means and covariances equal ``m``.

    The last column of ``m`` is the label. The points are the means plus the
    columns of a covariance root times orthonormal contrasts.
    """
    d = len(m.mean)
    covariance = m.scatter / m.n
    scale = np.sqrt(np.clip(np.diag(covariance), 0.0, None))
    unit = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(unit, unit))
    root = (vectors * np.sqrt(np.clip(values, 0.0, None))) * scale[:, None]
    contrasts = np.zeros((d, d + 1))
    for i in range(d):
        contrasts[i, : i + 1] = 1.0
        contrasts[i, i + 1] = -(i + 1)
        contrasts[i] /= np.linalg.norm(contrasts[i])
    points = m.mean[:, None] + np.sqrt(d + 1) * (root @ contrasts)
    rows = pa.table(
        {
            "x": pa.array(list(points[:-1].T), pa.list_(pa.float64())),
            label: points[-1],
            weight: np.full(d + 1, m.n / (d + 1)),
        }
    )
    return spark.createDataFrame(rows).select(array_to_vector("x").alias(features_col), label, weight).coalesce(1)


def linear_sse(m: Moments, coefficients: np.ndarray, intercept: float) -> float:
    """Squared error of a linear model on the rows behind ``m``."""
    direction = np.append(-np.asarray(coefficients), 1.0)
    bias = direction @ m.mean - intercept
    return float(direction @ m.scatter @ direction + m.n * bias * bias)
