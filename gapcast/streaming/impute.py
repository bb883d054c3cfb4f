"""Fill gaps in a stream of messages with the models of a registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gapcast.operators.models import SPECS, FittedModel
from gapcast.operators.registry import ModelRegistry
from gapcast.plans.imputation import route_messages, score_by_label
from gapcast.schema import TIMESTAMP
from gapcast.sources.sinks import write_raw_messages


class ModelCache:
    """Newest models of some algorithms by label; reloads only what is new."""

    def __init__(self, registry: ModelRegistry, algorithms: Sequence[str]):
        self.registry = registry
        self.algorithms = list(algorithms)
        if unknown := sorted(set(self.algorithms) - set(SPECS)):
            raise ValueError(f"unknown algorithms {unknown}; there are {sorted(SPECS)}")
        self._loaded: dict[str, FittedModel] = {}

    def by_label(self) -> dict[str, list[FittedModel]]:
        newest = {m["path"]: m for m in self.registry.latest() if m["algorithm"] in self.algorithms}
        self._loaded = {p: self._loaded.get(p) or self.registry.load_manifest(m) for p, m in newest.items()}
        models: dict[str, list[FittedModel]] = {}
        for fitted in sorted(self._loaded.values(), key=lambda f: self.algorithms.index(f.algorithm)):
            models.setdefault(fitted.label, []).append(fitted)
        return models


def stream_impute(
    messages: DataFrame,
    registry: ModelRegistry,
    algorithms: str | Sequence[str],
    output_dir: str,
    checkpoint_dir: str,
    rejects_dir: str,
    raw_dir: str | None = None,
    schema: T.StructType | None = None,
    timestamp: str = TIMESTAMP,
    value: str = "value",
    tz: str = "UTC",
    several_missing: str = "reject",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score every micro-batch like a table and write it as parquet.

    Every message ends in ``output_dir`` or, with a reason, in ``rejects_dir``.
    Each batch overwrites its own ``batch_id`` folder: a batch replayed after a
    failure leaves the same files, so every reading is written once. Models are
    only loaded here; training is a batch job, and a model saved meanwhile is
    picked up by the next batch. A registry without a model of the algorithms is
    refused at the start.
    """
    models = ModelCache(registry, [algorithms] if isinstance(algorithms, str) else algorithms)
    if not models.by_label():
        raise ValueError(f"no model of {models.algorithms} in {registry.root}")

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        if raw_dir is not None:
            write_raw_messages(batch, f"{raw_dir}/batch_id={batch_id}", value)
        routed = route_messages(batch, schema, timestamp, value, several_missing=several_missing)
        routed = routed.persist(StorageLevel.MEMORY_AND_DISK)  # read for the filled readings and for the rejects
        try:
            filled, rejects = score_by_label(routed, models.by_label(), schema, timestamp, tz)
            filled.write.mode("overwrite").parquet(f"{output_dir}/batch_id={batch_id}")
            rejects.write.mode("overwrite").parquet(f"{rejects_dir}/batch_id={batch_id}")
        finally:
            routed.unpersist()

    return (
        messages.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
