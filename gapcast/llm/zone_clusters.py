"""Exact k-means on whole numbers over blocks that follow a space-filling curve.

Vectors are laid along a Hilbert curve of the dimensions that vary most and cut
into blocks of neighbours, each with a box of least and largest components: a
zone map, written once. In every round the distances from a block's box to the
centroids bound those of its vectors, so most centroids are ruled out for the
whole block; the rest are compared exactly, all vectors of a block at once. A
block with one centroid left adds its stored sums without looking at a vector.
Centroids and sums per centroid are all that moves between driver and tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.llm.tables import partitions, stage

# Vectors in a block; dimensions and bits of each on the curve (8 x 7 bits fit a long).
BLOCK, CURVE_DIMS, CURVE_BITS = 256, 8, 7
# Components beyond this could bring a squared distance out of a long (up to 64 dimensions).
MOST = 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of the vectors with ``dims`` finite components in range."""
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    sound = F.transform(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float(MOST))))
    good = (F.size(vector_col) == dims) & F.forall(sound, lambda ok: ok)
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of whole coordinates below 2**bits) on a Hilbert curve.

    Coordinates are turned from the top bit down into the frame of the quadrant
    that the curve has entered, then Gray decoded and interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            inside = (x[i] >> bit & 1).astype(bool)
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where(x[n - 1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _curve(whole: DataFrame, dims: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The dimensions that vary most, and the least and largest value of each: one row to the driver."""
    at = [F.element_at("v", i + 1) for i in range(dims)]
    row = whole.agg(
        F.array(*[F.variance(a) for a in at]).alias("spread"), F.array(*[F.min(a) for a in at]).alias("low"), F.array(*[F.max(a) for a in at]).alias("high")
    ).first()
    spread = [s or 0.0 for s in row["spread"]]
    chosen = sorted(range(dims), key=lambda i: (-spread[i], i))[: min(CURVE_DIMS, dims)]
    return chosen, *(np.array([(row[c][i] or 0) for i in chosen], np.int64) for c in ("low", "high"))


def _placed(whole: DataFrame, dims: int) -> DataFrame:
    """(id, v, key): places on the curve."""
    chosen, low, high = _curve(whole, dims)
    width = np.maximum(high - low, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            cells = (v[:, chosen] - low) * ((1 << CURVE_BITS) - 1) // width
            key = hilbert_keys(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key)], ["id", "v", "key"])

    return whole.mapInArrow(run, T.StructType([*whole.schema.fields, T.StructField("key", T.LongType())]))


def zone_blocks(whole: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """(ids, vectors, low, high, total): blocks of neighbours on the curve, with their boxes and sums.

    Range partitions of (key, hash of the id): a place on the curve that very many
    vectors share is split like any other.
    """
    spark = whole.sparkSession
    kind = whole.schema["id"].dataType
    placed = _placed(whole, dims).withColumn("tie", F.xxhash64("id"))
    ordered = placed.repartitionByRange(partitions(spark), "key", "tie").sortWithinPartitions("key", "tie").select("id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            full = table.num_rows // block * block
            for at in range(0, full, block):
                yield made(table.slice(at, block))
            held = table.slice(full).to_batches()
        if held:
            yield made(pa.Table.from_batches(held).combine_chunks())

    def made(table: pa.Table) -> pa.RecordBatch:
        ids = table.column(0).combine_chunks()
        v = _matrix(table.column(1).combine_chunks(), dims)
        parts = [v.astype("<i4"), v.min(axis=0), v.max(axis=0), v.sum(axis=0)]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["ids", "vectors", "low", "high", "total"])

    fields = [T.StructField("ids", T.ArrayType(kind))] + [T.StructField(c, T.BinaryType()) for c in ("vectors", "low", "high", "total")]
    return stage(ordered.mapInArrow(run, T.StructType(fields)), "zone-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some point of a box, ties included.

    A centroid is out where its least distance to the box exceeds another's largest.
    """
    near = np.maximum(0, np.maximum(low - centroids, centroids - high))
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())


def nearest(v: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of every vector among ``numbers``, exactly; of equal ones the smaller number."""
    best = np.full(len(v), numbers[0])
    least = ((v - centroids[numbers[0]]) ** 2).sum(axis=1)
    for c in numbers[1:]:
        distance = ((v - centroids[c]) ** 2).sum(axis=1)
        closer = distance < least
        best[closer], least[closer] = c, distance[closer]
    return best, least


def _unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        ids = batch.column(0)[i].values
        low, high, total = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (2, 3, 4))
        yield ids, batch.column(1)[i].as_buffer(), low, high, total


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floors of the exact means; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for ids, packed, low, high, total in _unpacked(batch, dims):
                numbers = candidates(low, high, centroids)
                if len(numbers) == 1:
                    sums[numbers[0]] += total
                    counts[numbers[0]] += len(ids)
                    continue
                v = np.frombuffer(packed, "<i4").reshape(-1, dims).astype(np.int64)
                best, _ = nearest(v, centroids, numbers)
                for c in numbers:
                    own = best == c
                    sums[c] += v[own].sum(axis=0)
                    counts[c] += own.sum()
        used = np.flatnonzero(counts)
        lists = pa.array([sums[c].tolist() for c in used], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used]), lists], ["cluster", "n", "sums"])

    parts = blocks.select("ids", "vectors", "low", "high", "total").mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")
    exact = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # a row per centroid
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return after


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]
    kind = blocks.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed, low, high, _ in _unpacked(batch, dims):
                v = np.frombuffer(packed, "<i4").reshape(-1, dims).astype(np.int64)
                best, least = nearest(v, centroids, candidates(low, high, centroids))
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(least)], ["id", "cluster", "distance"])

    fields = [T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    return blocks.mapInArrow(run, T.StructType(fields))


@dataclass(frozen=True)
class ZoneClusters:
    """Final centroids, and (id, cluster, distance, cluster_inertia, inertia) of every vector kept."""

    centroids: np.ndarray
    members: DataFrame

    def centroid_digests(self) -> list[str]:
        """sha256 of each centroid's components as decimal numbers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest sha256 of ``seed:id``, in the order of the hash."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = whole.where("id IS NOT NULL").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    k: int = 40,
    rounds: int = 5,
    scale: int = 256,
    seed: int = 2,
    block: int = BLOCK,
) -> ZoneClusters:
    """Clusters of the vectors with exactly ``dims`` finite components.

    Components become floor(scale * x). The first centroids are vectors chosen by
    a hash of their id; each round assigns every vector to the nearest centroid
    (squared Euclidean distance, the smaller number on ties) and moves centroids
    to the floor of the exact mean; those without vectors stay. Then vectors are
    assigned once more.

    Left out are vectors that are null, of another length, with a null or
    non-finite component, or with one of 2^27 or more after scaling (distances
    would leave a long). Rows without an id are clustered but are no first
    centroid. Repeated rows are vectors of their own, and may give two equal
    centroids, of which the smaller number wins. With fewer than ``k`` vectors
    there are fewer centroids; an empty table gives none. Other columns are not read.
    """
    whole = stage(whole_vectors(vectors, id_col, vector_col, dims, scale), "whole-vectors")
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        empty = whole.where(F.lit(False)).select(F.col("id").alias(id_col))
        names = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint"}
        return ZoneClusters(np.zeros((0, dims), np.int64), empty.withColumns({c: F.lit(None).cast(t) for c, t in names.items()}))
    blocks = zone_blocks(whole, dims, block)
    for _ in range(rounds):
        centroids = _means(blocks, centroids)
    members = stage(_assigned(blocks, centroids), "zone-members")
    sums = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per centroid
    inertia = {r["cluster"]: int(r["s"]) for r in sums}

    def of_cluster(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("cluster") + 1)

    own = of_cluster([inertia.get(c, 0) for c in range(len(centroids))])
    total = F.lit(sum(inertia.values())).cast("bigint")
    return ZoneClusters(
        centroids, members.select(F.col("id").alias(id_col), "cluster", "distance", own.alias("cluster_inertia"), total.alias("inertia"))
    )
