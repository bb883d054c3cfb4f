"""Fitted models as plain arrays: nodes, coefficients, steps.

Flat models score batches of rows with numpy inside a task. They do what their
MLlib originals cannot: several models, chosen by the row, in one pass over a
table, and trees read at any depth, as every node keeps the mean of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.operators.features import FEATURES
from gapcast.operators.models import TREES, FittedModel
from gapcast.scratch import shared_dir


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees one after the other; ``left`` and ``right`` are -1 in a leaf."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    mean: np.ndarray
    weights: np.ndarray

    def descend(self, rows: np.ndarray, tree: int, depths: Sequence[int] | None = None) -> Iterator[np.ndarray]:
        """Predictions of one tree cut off at each of the rising ``depths``; without them, of the whole tree."""
        node = np.full(len(rows), self.roots[tree])
        level, every = 0, np.arange(len(rows))
        for depth in depths if depths is not None else [None]:
            while depth is None or level < depth:
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                smaller = rows[every[inner], self.feature[at]] <= self.threshold[at]  # NaN goes right, as in MLlib
                node[inner] = np.where(smaller, self.left[at], self.right[at])
                level += 1
            yield self.mean[node]

    def apply(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for tree, weight in enumerate(self.weights):
            total += weight * next(self.descend(rows, tree))
        return total


@dataclass(frozen=True)
class FlatLinear:
    coefficients: np.ndarray
    intercept: float

    def apply(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for i, c in enumerate(self.coefficients):  # in a fixed order: a row's value does not depend on its batch
            total += rows[:, i] * c
        return total + self.intercept


@dataclass(frozen=True)
class FlatSteps:
    """Boundaries with their predictions; in between a straight line, beyond the ends flat."""

    index: int
    boundaries: np.ndarray
    predictions: np.ndarray

    def apply(self, rows: np.ndarray) -> np.ndarray:
        x, b, p = rows[:, self.index], self.boundaries, self.predictions
        if len(b) == 1:
            return np.full(len(x), p[0])
        upper = np.clip(np.searchsorted(b, x), 1, len(b) - 1)
        lower = upper - 1
        between = p[lower] + (p[upper] - p[lower]) * (x - b[lower]) / (b[upper] - b[lower])
        return np.where(x <= b[0], p[0], np.where(x >= b[-1], p[-1], np.where(x == b[upper], p[upper], between)))


def flat_trees(spark: SparkSession, model, weights: Sequence[float]) -> FlatTrees:
    """The nodes of a tree or an ensemble, from a saved copy: its size is that of the model."""
    path = shared_dir(spark, "flat-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    split = F.col("split")
    nodes = data.select(
        "treeID", "id", "prediction", "leftChild", "rightChild",
        split["featureIndex"].alias("feature"),
        F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        split["numCategories"].alias("categories"),
    ).toPandas().sort_values(["treeID", "id"])
    if (nodes["categories"] >= 0).any():
        raise ValueError("splits by category have no flat form")
    # Saved ids count the nodes of a tree from 0; places count all nodes.
    sizes = nodes.groupby("treeID").size().to_numpy()
    roots = np.cumsum(sizes) - sizes
    base = np.repeat(roots, sizes)

    def child(name: str) -> np.ndarray:
        ids = nodes[name].to_numpy()
        return np.where(ids >= 0, ids + base, -1)

    return FlatTrees(
        roots,
        nodes["feature"].to_numpy(np.int64),
        nodes["threshold"].to_numpy(np.float64),
        child("leftChild"),
        child("rightChild"),
        nodes["prediction"].to_numpy(np.float64),
        np.asarray(weights, np.float64),
    )


def flatten(spark: SparkSession, fitted: FittedModel) -> FlatTrees | FlatLinear | FlatSteps:
    """The flat form of a fitted model, made once."""
    if fitted.flat is None:
        fitted.flat = _flatten(spark, fitted)
    return fitted.flat


def _flatten(spark: SparkSession, fitted: FittedModel) -> FlatTrees | FlatLinear | FlatSteps:
    model = fitted.model
    if fitted.algorithm == "linear":
        return FlatLinear(model.coefficients.toArray(), float(model.intercept))
    if fitted.algorithm == "isotonic":
        return FlatSteps(model.getFeatureIndex(), model.boundaries.toArray(), model.predictions.toArray())
    if fitted.algorithm not in TREES:
        raise ValueError(f"no flat form of {fitted.algorithm}")
    weights = {"decision_tree": lambda: [1.0], "gbt": lambda: model.treeWeights, "random_forest": lambda: [1.0 / model.getNumTrees] * model.getNumTrees}
    return flat_trees(spark, model, weights[fitted.algorithm]())


# ----------------------------------------------------- many models, one pass


def predict_by_key(spark: SparkSession, models: Mapping[str, Sequence[FittedModel]], key: Column) -> Column:
    """The predictions (array, in the order of its models) of the models that ``key`` names.

    One vectorised function for all models: rows of a batch are dealt to the models
    by their key. Null where the key is null or names no model, or a feature is null.
    """
    features = sorted({f for fitted in models.values() for m in fitted for f in m.features})
    flat = {name: [(flatten(spark, m), [features.index(f) for f in m.features]) for m in fitted] for name, fitted in models.items()}

    @F.pandas_udf("array<double>")
    def dispatch(keys: pd.Series, *columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns]) if columns else np.zeros((len(keys), 0))
        out = pd.Series([None] * len(keys), dtype=object)
        for name in keys.dropna().unique():
            for_models = flat.get(name, [])
            needed = sorted({i for _, places in for_models for i in places})
            own = np.flatnonzero((keys == name).to_numpy() & ~np.isnan(rows[:, needed]).any(axis=1))
            found = [model.apply(rows[np.ix_(own, places)]) for model, places in for_models]
            if found:
                out.iloc[own] = pd.Series(list(np.stack(found, axis=1)), index=own, dtype=object)
        return out

    return dispatch(key, *[F.col(f).cast("double") for f in features])


# ------------------------------------------------------------ cut-off trees


def truncated_errors(
    flat: FlatTrees, table: DataFrame, label: str, depths: Sequence[int], counts: Sequence[int] = (1,)
) -> dict[tuple[int, int], float]:
    """RMSE per (depth, number of trees) on assembled rows, in one pass.

    The prediction is the mean of the first trees, each cut off at the depth.
    """
    depths, counts = sorted(set(depths)), sorted(set(counts))
    trees, depths_at = max(counts), {d: i for i, d in enumerate(depths)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, n = np.zeros((len(depths), len(counts))), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False)
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            sums = np.zeros((len(depths), len(y)))
            for tree in range(trees):
                for i, found in enumerate(flat.descend(rows, tree, depths)):
                    sums[i] += found
                if tree + 1 in counts:
                    squares[:, counts.index(tree + 1)] += ((sums / (tree + 1) - y) ** 2).sum(axis=1)
            n += len(y)
        cells = [(d, t, squares[i, j], n) for d, i in depths_at.items() for j, t in enumerate(counts)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], ["depth", "trees", "squares", "n"])

    rows = table.select(vector_to_array(FEATURES).alias("x"), F.col(label).cast("double").alias("y"))
    parts = rows.mapInArrow(run, "depth long, trees long, squares double, n long").groupBy("depth", "trees")
    found = parts.agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse")).collect()  # a row per depth and number of trees
    return {(r["depth"], r["trees"]): r["rmse"] for r in found}
