"""SimHash near-duplicates found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.llm.graph import connected_components
from gapcast.llm.tables import stage

# Shingles hashed and counted at a time: bounds memory for texts of any length.
CHUNK = 1 << 16


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII blanks, A-Z in lower case, as UTF-8."""
    return text.encode().lower().split() if text else []


def shingles(tokens: list[bytes], size: int) -> Iterator[bytes]:
    """Every run of ``size`` words, joined by a space; of fewer words, the whole sequence."""
    if not tokens:
        return iter(())
    return map(b" ".join, zip(*[tokens[i:] for i in range(min(size, len(tokens)))]))


def _hash_chunks(tokens: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    total = max(len(tokens) - size + 1, min(len(tokens), 1))
    runs, digest = shingles(tokens, size), xxhash.xxh64_intdigest
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        yield np.fromiter((digest(s, seed) for s in islice(runs, n)), np.uint64, n)


def fingerprint(tokens: list[bytes], size: int, seed: int) -> np.ndarray:
    """Bits set in over half of the shingle hashes; 0 without words. Signed, as Spark keeps them."""
    return _majority(_hash_chunks(tokens, size, seed))


def _majority(chunks: Iterable[np.ndarray]) -> np.ndarray:
    ones, total = np.zeros(64, np.int64), 0
    for hashes in chunks:
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > total, bitorder="little").view(np.int64)


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    seed: int = 42,
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, fingerprint long) of every row, and ``carried`` columns. Null and empty text give fingerprint zero."""
    extra = [c.alias(name) for name, c in (carried or {}).items()]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra)
    kept = [f for f in source.schema.fields if f.name != "text"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [int(fingerprint(words(t.as_py()), size, seed)[0]) for t in batch.column(1)]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.int64())], [f.name for f in kept] + ["fingerprint"])

    return source.mapInArrow(hashed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", fingerprint long")


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed numbers."""
    masks, layer = {0}, {0}
    for _ in range(radius):
        layer = {m | (1 << i) for m in layer for i in range(64) if not m >> i & 1}
        masks |= layer
    return sorted(m - (1 << 64) if m >> 63 else m for m in masks)


def close_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``radius`` bits.

    Every distinct fingerprint emits all variants within half the radius (rounded
    up), marked as inner where they lie within half the radius rounded down.
    Fingerprints within the radius meet on a variant that is inner for one of
    them. Per variant each is linked with the smallest inner one, which is at most
    the radius away: a star, not all pairs. A variant can be met by no more
    fingerprints than its ball holds (65 for radius 2), whatever the table.
    """
    outer, inner = ball((radius + 1) // 2), ball(radius // 2)
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(m in set(inner)).alias("inner")) for m in outer])
    met = prints.select("fingerprint", F.explode(masks).alias("m")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("m.mask")).alias("variant"), "m.inner"
    )
    centre = F.min(F.when(F.col("inner"), F.col("fingerprint"))).over(Window.partitionBy("variant"))
    pairs = met.select("fingerprint", centre.alias("centre")).where("fingerprint <> centre")
    pairs = pairs.select(F.greatest("fingerprint", "centre").alias("a"), F.least("fingerprint", "centre").alias("b"))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 2,
    size: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(id, fingerprint long, component_id) of every row.

    Rows with equal fingerprints are one node; nodes link at ``radius`` or fewer
    differing bits; ``component_id`` is the smallest id that links reach, its own
    included. Rows without words share fingerprint zero and link like any other.
    A null id never is the smallest; a component of null ids alone has a null
    component_id. Repeated rows share fingerprint and component. Other columns of
    the input are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    nodes = _linked(prints, radius)
    least = stage(nodes.groupBy("component").agg(F.min("first").alias("component_id")), "fingerprint-components")
    classes = stage(nodes.join(least, "component").select("fingerprint", "component_id"), "fingerprint-classes")
    # Both sides come from files: one fingerprint with a third of all rows is split by adaptive execution.
    return prints.join(classes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def _linked(prints: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, first, component): smallest id and component of every distinct fingerprint."""
    nodes = stage(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "fingerprint-nodes")
    found = connected_components(close_pairs(nodes, radius)).select(F.col("node").alias("fingerprint"), "component")
    return nodes.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def one_of_each_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 2,
    size: int = 3,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group that ``near_duplicates`` links, one row stays.

    It is the row of the smallest id; a row without an id stays only where none of
    its group has one. Rows are chosen, not ids: of rows that share an id each
    belongs to the group of its own text, and where several of a group hold the
    smallest id, the one of the least text hash stays. Rows equal in id and text
    are one. An empty table gives an empty table.
    """
    given = F.col(id_col).isNull()
    keys = {f"row_key_{i}": F.xxhash64(F.lit(i), given, id_col, F.col(text_col).isNull(), text_col) for i in range(2)}
    prints = stage(fingerprints(docs, id_col, text_col, size, seed, keys), "row-fingerprints")
    nodes = stage(_linked(prints, radius).select("fingerprint", "component"), "fingerprint-groups")
    order = F.struct(F.col("id").isNull().alias("missing"), "id", *keys)
    best = prints.join(nodes, "fingerprint").groupBy("component").agg(F.min(order).alias("best"))
    kept = stage(best.select(*[f"best.{k}" for k in keys]), "kept-rows")
    # Repeated rows fall together before the shuffle; the join then reuses its partitioning.
    rows = docs.withColumns(keys).dropDuplicates(list(keys))
    return rows.join(kept, list(keys), "left_semi").select(*docs.columns)
