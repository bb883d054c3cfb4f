"""Saved models with their manifests."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.operators.models import SPECS, FittedModel

MANIFEST = (
    "algorithm string, label string, features array<string>, params string, metrics string, "
    "split_seed long, split string, created_ms long, spark_version string, path string"
)


def _as_text(split: Mapping[str, Any] | None) -> str | None:
    return None if split is None else json.dumps(split, sort_keys=True)


class ModelRegistry:
    """Models under ``root/algorithm/label/version``, on a shared file system.

    Each save is a new version. Its manifest is written after the model, so a
    save that broke off is never found, and a reader keeps the version it has.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def save(self, fitted: FittedModel, split_seed: int | None = None, split: Mapping[str, Any] | None = None) -> str:
        """``split`` says how training rows were chosen and prepared: seed, key, share, time zone, grid."""
        created = int(time.time() * 1000)
        path = f"{self.root}/{fitted.algorithm}/{fitted.label}/v{created}-{uuid.uuid4().hex[:8]}"
        fitted.model.write().overwrite().save(f"{path}/model")
        row = (
            fitted.algorithm,
            fitted.label,
            list(fitted.features),
            json.dumps(fitted.params, sort_keys=True),
            json.dumps(fitted.metrics, sort_keys=True),
            split_seed,
            _as_text(split),
            created,
            self.spark.version,
            path,
        )
        manifest = self.spark.createDataFrame([row], MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{path}/manifest")
        return path

    def manifests(self, algorithm: str = "*", label: str = "*") -> DataFrame:
        """All versions; an empty table when there is none."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.root}/{algorithm}/{label}/v*/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def latest(self, algorithm: str = "*", label: str = "*") -> list:
        """Newest manifest per algorithm and label: a row per trained model."""
        newest = F.max_by(F.struct("*"), F.struct("created_ms", "path")).alias("m")
        return self.manifests(algorithm, label).groupBy("algorithm", "label").agg(newest).select("m.*").collect()

    def load_manifest(self, m) -> FittedModel:
        model = SPECS[m["algorithm"]].model.load(f"{m['path']}/model")
        return FittedModel(
            m["algorithm"], m["label"], list(m["features"]), model, json.loads(m["params"]), json.loads(m["metrics"])
        )

    def load(self, algorithm: str, label: str) -> FittedModel | None:
        """The newest model, or None."""
        found = self.latest(algorithm, label)
        return self.load_manifest(found[0]) if found else None

    def load_all(self, algorithm: str) -> dict[str, FittedModel]:
        """The newest model of every label, keyed by label."""
        return {m["label"]: self.load_manifest(m) for m in self.latest(algorithm)}

    def train_or_load(
        self,
        algorithm: str,
        label: str,
        features: list[str],
        train: Callable[[], FittedModel],
        retrain: bool = False,
        split_seed: int | None = None,
        split: Mapping[str, Any] | None = None,
    ) -> FittedModel:
        """Load the saved model, else train and save one.

        A saved model whose feature list differs from the table's is refused: it
        would read the wrong columns. So is one trained on another ``split`` than
        given: it may have seen the rows it is to be measured on. ``retrain``
        replaces it.
        """
        found = [] if retrain else self.latest(algorithm, label)
        if not found:
            fitted = train()
            self.save(fitted, split_seed, split)
            return fitted
        saved = found[0]
        if list(saved["features"]) != list(features):
            raise ValueError(f"saved {algorithm} model of {label} has features {list(saved['features'])}, not {list(features)}")
        if split is not None and saved["split"] != _as_text(split):
            raise ValueError(f"saved {algorithm} model of {label} was trained with {saved['split']}, not {_as_text(split)}")
        return self.load_manifest(saved)
