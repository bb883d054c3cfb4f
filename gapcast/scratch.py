"""Where jobs put written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _base_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession, name: str = "run") -> str:
    """A new path under the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. A machine-local
    temporary folder is used only when driver and executors are one process.
    """
    base = _base_dir(spark)
    if base is None:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="gapcast-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give tree learners a place to cut their lineage, unless one is set."""
    if _base_dir(spark) is None and _is_local(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gapcast-checkpoint-"))
