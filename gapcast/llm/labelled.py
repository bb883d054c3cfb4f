"""What the text classifiers share: labels, bounded samples, and texts in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text_index: int, volume_limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Pieces of a batch with about ``volume_limit`` bytes of text each; a longer text is a piece of its own."""
    first, volume = 0, 0
    column = batch.column(text_index)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, size in enumerate(sizes):
        volume += size
        if volume >= volume_limit or i == len(sizes) - 1:
            piece = batch.slice(first, i + 1 - first)
            yield piece, piece.column(text_index).to_pylist()
            first, volume = i + 1, 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, max_rows: int
) -> DataFrame:
    """(id, text, label double) of at most ``max_rows`` labelled documents, for a fit on the driver.

    ``learn`` tells from the columns of ``labels`` which labels may be used. Null
    labels and ids are left out; a document with several labels has their mean,
    rounded up at a half. Sampled ids are those with the least hashes, so the
    sample is the same on every run. Rows that share an id count once, with the
    least of their texts.
    """
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(
        F.when(F.avg(label_col) >= 0.5, 1.0).otherwise(0.0).alias("label")
    )
    present = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = present.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # the broadcast side has max_rows rows at most
    return found.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def with_columns(
    docs: DataFrame, text_col: str, fields: str, score: Callable[[list[str | None]], list[np.ndarray | list]]
) -> DataFrame:
    """All columns of ``docs`` but those named in ``fields``, and the columns that ``score`` makes of the texts."""
    added = T.StructType.fromDDL(fields)
    source = docs.drop(*added.names)
    if text_col in added.names:
        raise ValueError(f"the text column cannot be named {text_col}")
    schema = T.StructType([*source.schema.fields, *added.fields])
    index, arrow = source.columns.index(text_col), [pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, index):
                made = [pa.array(values, kind) for values, kind in zip(score(texts), arrow)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], [*piece.schema.names, *added.names])

    return source.mapInArrow(run, schema)
