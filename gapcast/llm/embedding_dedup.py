"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within eps = sqrt(2 - 2t) of each
other. Vectors are sorted by their cells, of width eps, on the leading principal
dimensions, and the sorted sequence is cut into blocks, written once in bands of
neighbours. A tree of intervals over the blocks is joined with itself from the
root down: two intervals go on only where their boxes come within eps of each
other on the leading dimensions, which is a lower bound for the whole vectors.
What is left says which bands meet. Tasks read their parts of two bands from the
written sequence, so no block is shuffled for its pairs, and join those blocks
whose boxes are close by the same recursion down to short intervals. There a
product of some dimensions and the norm of the rest bounds the cosine from above.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.llm.graph import connected_components
from gapcast.llm.tables import settings, stage

# Vectors in a block, and their bytes at most.
BLOCK, BLOCK_BYTES = 16384, 4 << 20
LEAF = 512
FANOUT = 8
# Blocks in the shortest interval of the tree; below it boxes are compared where blocks meet.
TILE = 16
# Bytes of vectors: in a range partition, in one side of a task that joins blocks, and in a band (of 64 at most).
PART, SIDE, BAND, BANDS = 16 << 20, 64 << 20, 256 << 20, 64
# Edges, and bytes of prepared blocks, that a task holds.
EDGES, PREPARED = 1 << 20, 128 << 20
# Boxes are compared with this allowance for rounding, so that none is skipped wrongly.
SLACK = 1e-6


@dataclass
class Grid:
    """Leading principal dimensions (columns of ``axes``), those that bound products (``wide``), and the width of cells."""

    axes: np.ndarray
    wide: np.ndarray | None
    eps: float
    dims: int
    kind: str  # of the components, as numpy names it

    def block(self) -> int:
        """Vectors in a block."""
        return max(1, min(BLOCK, BLOCK_BYTES // (self.dims * np.dtype(self.kind).itemsize)))


def _moments(rows: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of squares of all unit vectors: dims x dims numbers per task."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        n = 0
        for batch in batches:
            x = _units(_matrix(batch.column(0), dims))
            total[:dims] += x.T @ x
            total[dims] += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((dims + 1) * dims)
        for batch in batches:
            n += sum(batch.column(0).to_pylist())
            for part in batch.column(1).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    schema = "n long, sums binary"
    parts = rows.select("vector").mapInArrow(gather, schema).repartition(8).mapInArrow(add, schema).collect()
    n = sum(r["n"] for r in parts)
    total = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros((dims + 1) * dims)).reshape(dims + 1, dims)
    return n, total[dims], total[:dims]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as they are given; shorter ones are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    flat = flat[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else flat[:0]
    x = np.zeros((len(lengths), dims), flat.dtype)
    x[np.arange(dims) < lengths[:, None]] = flat
    return x


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(scale > 0, scale, 1)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _principal(rows: DataFrame, dims: int, leading: int, cosine: float, eps: float) -> tuple[int, Grid]:
    n, total, squares = _moments(rows, dims)
    mean, squares = total / max(n, 1), squares / max(n, 1)
    spread, axes = np.linalg.eigh(squares - np.outer(mean, mean))
    axes = axes[:, ::-1]
    wide = _bounding(spread[::-1], np.einsum("ji,jk,ki->i", axes, squares, axes), mean @ axes, cosine)
    kind = "f4" if rows.schema["vector"].dataType.elementType == T.FloatType() else "f8"
    return n, Grid(axes[:, :leading], axes[:, :wide] if wide else None, eps, dims, kind)


def _bounding(spread: np.ndarray, energy: np.ndarray, mean: np.ndarray, cosine: float) -> int:
    """How many leading dimensions to multiply before all; 0 if that would save little.

    Norms of the rest account for 1 - energy of a product; chance products of the
    leading dimensions should then reach the cosine at 4.5 deviations only. This
    decides how fast blocks are joined, not what is found.
    """
    for n in range(4, len(spread) * 5 // 8 + 1, 4):
        chance = mean[:n] @ mean[:n] + 4.5 * np.sqrt(np.sum(spread[:n] ** 2))
        if 1 - energy[:n].sum() + chance <= cosine:
            return n
    return 0


def _sequence(rows: DataFrame, grid: Grid, parts: int, bands: int) -> DataFrame:
    """Blocks of the sorted sequence: number of the first class, hashes, multiplicities, vectors, box on the leading dimensions.

    Equal vectors are one class: those of a batch travel as one row, those of a
    range partition, which holds all of them, are put together there. Classes are
    numbered on in their partition, and the partitions dealt to bands in order.
    """
    dims, width, most = grid.dims, grid.dims * np.dtype(grid.kind).itemsize, grid.block()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((h2, h1))
            starts = _starts(h1[order], h2[order])
            kept, many = order[starts], np.diff(np.append(starts, len(order)))
            x = _matrix(batch.column(2).take(pa.array(kept)), dims)
            cells = np.floor(_units(x) @ grid.axes / grid.eps).astype(np.int16)
            offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width))
            vectors = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])
            columns = [pa.array(list(cells), pa.list_(pa.int16())), pa.array(h1[kept]), pa.array(h2[kept]), pa.array(many), vectors]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "h1", "h2", "many", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = merged(pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]))
            while held.num_rows > most:  # copies of the last one may follow
                yield block(part, index, held.slice(0, most))
                held, index = held.slice(most), index + 1
        if held is not None:
            yield block(part, index, held)

    def merged(table: pa.Table) -> pa.Table:
        h1, h2, many = (table.column(c).to_numpy() for c in ("h1", "h2", "many"))
        starts = _starts(h1, h2)
        if len(starts) == len(many):
            return table
        return table.take(pa.array(starts)).set_column(2, "many", pa.array(np.add.reduceat(many, starts)))

    def block(part: int, index: int, held: pa.Table) -> pa.RecordBatch:
        raw = b"".join(held.column("vector").to_pylist())
        leading = _units(np.frombuffer(raw, grid.kind).reshape(-1, dims)) @ grid.axes
        h1, h2, many = (held.column(c).to_numpy().astype(np.int64).tobytes() for c in ("h1", "h2", "many"))
        band, first = min(part * bands // parts, bands - 1), (part << 33) + index * most
        values = [part, index, first, h1, h2, many, raw, leading.min(axis=0).tolist(), leading.max(axis=0).tolist(), band]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

    names = ["part", "index", "first", "h1", "h2", "many", "vectors", "low", "high", "band"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2, pa.int32()]
    celled = rows.select("h1", "h2", "vector").mapInArrow(place, "cell array<smallint>, h1 long, h2 long, many long, vector binary")
    keys = ["cell", "h1", "h2"]
    ordered = celled.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("h1", "h2", "many", "vector")
    return ordered.mapInArrow(
        cut,
        "part int, index int, first long, h1 binary, h2 binary, many binary, vectors binary, low array<double>, high array<double>, band int",
    )


def _starts(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where runs of equal hashes begin."""
    return np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))


def _apart(a_low, a_high, b_low, b_high):
    """Squared distance of two boxes."""
    gaps = F.zip_with(
        F.zip_with(a_low, b_high, lambda x, y: x - y),
        F.zip_with(b_low, a_high, lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)


def _close(a: str, b: str, eps: float):
    """Boxes of two sides that come within eps."""
    return _apart(F.col(f"{a}_low"), F.col(f"{a}_high"), F.col(f"{b}_low"), F.col(f"{b}_high")) <= (eps + SLACK) ** 2


def _boxes(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(seq, low, high, band) of the blocks, numbered from 0 in the order of the sequence, and their number."""
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per partition
    firsts, first = [], 0
    for part, n in counts:
        firsts.append((part, first))
        first += n
    offsets = blocks.sparkSession.createDataFrame(firsts, "part int, first_seq long")
    numbered = blocks.select("part", "index", "low", "high", "band").join(F.broadcast(offsets), "part")  # one row per partition
    return stage(numbered.select((F.col("first_seq") + F.col("index")).alias("seq"), "low", "high", "band"), "block-boxes"), first


def _tile_pairs(boxes: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """(a, b), a <= b: intervals of TILE blocks whose boxes come within eps, found from the root of the interval tree down."""
    dims = boxes.select(F.max(F.size("low"))).first()[0] or 0

    def above(boxes: DataFrame, fanout: int) -> DataFrame:
        corners = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(dims)] + [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(dims)]
        up = boxes.groupBy(F.floor(F.col("seq") / fanout).alias("seq")).agg(*corners)
        return stage(up.select(
            "seq",
            F.array(*[f"l{i}" for i in range(dims)]).alias("low"),
            F.array(*[f"h{i}" for i in range(dims)]).alias("high"),
        ), "interval-boxes")

    levels, last = [above(boxes, TILE)], (n_blocks - 1) // TILE
    while last:  # one level more for every factor of FANOUT
        last //= FANOUT
        levels.append(above(levels[-1], FANOUT))
    pairs = levels[-1].select(F.col("seq").alias("a"), F.col("seq").alias("b"))
    for boxes in levels[-2::-1]:
        child = boxes.withColumn("parent", F.floor(F.col("seq") / FANOUT))
        a, b = (child.select([F.col(c).alias(f"{side}_{c}") for c in child.columns]) for side in "ab")
        near = pairs.join(a, F.col("a") == F.col("a_parent")).join(b, F.col("b") == F.col("b_parent"))
        near = near.where("a_seq <= b_seq").where(_close("a", "b", eps))
        pairs = stage(near.select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b")), "interval-pairs")
    return pairs


def _meeting_bands(boxes: DataFrame, n_blocks: int, eps: float) -> dict[int, list[int]]:
    """For every band itself and the later ones that hold a tile close to one of its own."""
    pairs = _tile_pairs(boxes, n_blocks, eps)
    held = boxes.select(F.floor(F.col("seq") / TILE).alias("tile"), "band").distinct()
    a, b = (held.select(F.col("tile").alias(k), F.col("band").alias(f"{k}_band")) for k in "ab")
    met = pairs.join(a, "a").join(b, "b").where("a_band <= b_band").select("a_band", "b_band").distinct().collect()  # BANDS**2 rows at most
    bands = {r["a_band"] for r in met} | {r["b_band"] for r in met}
    return {k: sorted({k} | {r["b_band"] for r in met if r["a_band"] == k}) for k in sorted(bands)}


@dataclass
class Side:
    """A block made ready to be joined.

    A product of two rows of ``bound`` is the cosine or, if some dimensions are
    left out (``exact`` is false), no less than it: the last column is the norm of
    the rest. ``raw`` are the vectors as given, held while a pair is joined.
    """

    raw: np.ndarray | None
    bound: np.ndarray
    exact: bool
    low: np.ndarray
    high: np.ndarray
    single: np.ndarray | None = field(default=None)

    @staticmethod
    def of(raw: np.ndarray, axes: np.ndarray, wide: np.ndarray | None) -> Side:
        x = _units(raw)
        leading, bound = x @ axes, x
        if wide is not None:
            y = x @ wide
            bound = np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))])
        leaves = [leading[s : s + LEAF] for s in range(0, len(x), LEAF)]
        low, high = (np.array([f(leaf, axis=0) for leaf in leaves]) for f in (np.min, np.max))
        return Side(raw, bound.astype(np.float32), wide is None, low, high)

    def all(self) -> np.ndarray:
        """Unit vectors in single precision."""
        if self.exact:
            return self.bound
        if self.single is None:
            self.single = _units(self.raw).astype(np.float32)
        return self.single


def join_sides(a: Side, b: Side, cosine: float) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
    """(start in a, start in b, places) for every pair of leaves with links; a block may meet itself.

    Products are taken in single precision; those too close to the threshold to
    tell, and those of which only a bound is known, are taken in double precision.
    """
    same = a is b
    eps2 = (np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK) ** 2
    doubt = np.float32(4e-7 * (a.raw.shape[1] + 8))
    gaps = np.maximum(0, np.maximum(a.low[:, None] - b.high[None], b.low[None] - a.high[:, None]))
    near = (gaps * gaps).sum(axis=2) <= eps2
    room = np.empty(LEAF * LEAF, np.float32)
    for i, j in np.argwhere(np.triu(near) if same else near):
        s, t = i * LEAF, j * LEAF
        p, q = a.bound[s : s + LEAF], b.bound[t : t + LEAF]
        products = np.dot(p, q.T, out=room[: len(p) * len(q)].reshape(len(p), len(q)))
        if products.max() < cosine - doubt:
            continue
        places = np.flatnonzero(products >= cosine - doubt)
        exact = a.exact
        if not exact and len(places) > products.size >> 6:  # the bound tells little here
            products = np.dot(a.all()[s : s + LEAF], b.all()[t : t + LEAF].T, out=products)
            places = np.flatnonzero(products >= cosine - doubt)
            exact = True
        r, c = np.divmod(places, len(q))
        if same and s == t:
            r, c = r[r < c], c[r < c]
        unsure = np.flatnonzero(products[r, c] <= cosine + doubt) if exact else np.arange(len(r))
        if len(unsure):
            x, y = _units(a.raw[s + r[unsure]]), _units(b.raw[t + c[unsure]])
            kept = np.ones(len(r), bool)
            kept[unsure] = np.einsum("ij,ij->i", x, y) >= cosine
            r, c = r[kept], c[kept]
        if len(r):
            yield int(s), int(t), (r, c)


def join_blocks(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, cosine: float, wide: np.ndarray | None = None):
    """``join_sides`` of two arrays of vectors; y None joins x with itself."""
    a = Side.of(x, axes, wide)
    yield from join_sides(a, a if y is None else Side.of(y, axes, wide), cosine)


def _stars(mask: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same classes as all links of the mask: one per class at most."""
    r, c = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    mask = mask[np.ix_(r, c)]
    n = len(r)
    ids = np.concatenate([rows[r], columns[c]])
    root = np.full(len(ids), -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            up = np.flatnonzero(mask[front].any(axis=0) & (root[n:] < 0))
            root[n + up] = start
            back = np.flatnonzero(mask[:, up].any(axis=1) & (root[:n] < 0)) if len(up) else up
            root[back] = start
            front = back
    return ids, ids[root]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same classes as the given ones: one per class at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, up := root[root]):
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


class Found:
    """Links that a task has found: counts per class, and edges, thinned out when they are many."""

    def __init__(self) -> None:
        self.counts: dict[int, np.ndarray] = {}
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.limit = 0, EDGES

    def add(self, first: tuple[int, int], many: tuple[np.ndarray, np.ndarray], start: tuple[int, int], places: tuple[np.ndarray, np.ndarray]) -> None:
        at = [s + p for s, p in zip(start, places)]
        for k in (0, 1):
            counts = self.counts.setdefault(first[k], np.zeros(len(many[k]), np.int64))
            np.add.at(counts, at[k], many[1 - k][at[1 - k]])
        a, b = (f + p for f, p in zip(first, at))
        if len(a) > 4 * LEAF:
            mask = np.zeros((LEAF, LEAF), bool)
            mask[places] = True
            a, b = _stars(mask, *(f + s + np.arange(LEAF) for f, s in zip(first, start)))
        self.edges.append((a, b))
        self.held += len(a)
        if self.held > self.limit:
            self.edges = [self.thinned()]
            self.held = len(self.edges[0][0])
            self.limit = max(EDGES, 2 * self.held)

    def thinned(self) -> tuple[np.ndarray, np.ndarray]:
        return _forest(*(np.concatenate(e) for e in zip(*self.edges))) if self.edges else (np.zeros(0, np.int64),) * 2

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(class_id, n, null, null) and (null, null, a, b)."""
        names = ["class_id", "n", "a", "b"]
        for first, counts in self.counts.items():
            kept = np.flatnonzero(counts)
            none = pa.nulls(len(kept), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(first + kept), pa.array(counts[kept]), none, none], names)
        a, b = self.thinned()
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b)], names)


def _band_links(blocks: DataFrame, band: int, others: list[int], grid: Grid, cosine: float) -> DataFrame:
    """(class_id, n, a, b): what links the blocks of a band among themselves and with those of other bands.

    Every task reads a part of the band and a part of the others from the written
    blocks, so that nothing is shuffled and memory stays below a few parts.
    """
    spark, dims, kind = blocks.sparkSession, grid.dims, grid.kind
    prepared = max(2, PREPARED // (4 * grid.block() * dims))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: OrderedDict[int, Side] = OrderedDict()
        found = Found()

        def side(first: int, vectors: bytes) -> Side:
            raw = np.frombuffer(vectors, kind).reshape(-1, dims)
            if first not in ready:
                ready[first] = Side.of(raw, grid.axes, grid.wide)
            ready.move_to_end(first)
            ready[first].raw = raw
            while len(ready) > prepared:
                ready.popitem(last=False)
            return ready[first]

        for batch in batches:
            for row in batch.to_pylist():
                a, b = (side(row[f"{k}_first"], row[f"{k}_vectors"]) for k in "ab")
                many = tuple(np.frombuffer(row[f"{k}_many"], np.int64) for k in "ab")
                for s, t, places in join_sides(a, b, cosine):
                    found.add((row["a_first"], row["b_first"]), many, (s, t), places)
                for used in (a, b):
                    used.raw = used.single = None
        yield from found.batches()

    def half(k: str, bands: list[int]) -> DataFrame:
        return blocks.where(F.col("band").isin(bands)).select([F.col(c).alias(f"{k}_{c}") for c in ("first", "many", "vectors", "low", "high")])

    near = (F.col("a_first") <= F.col("b_first")) & _close("a", "b", grid.eps)
    rows = half("a", [band]).hint("shuffle_replicate_nl").join(half("b", others), near)
    rows = rows.select([f"{k}_{c}" for k in "ab" for c in ("first", "many", "vectors")])
    # Each side has parts enough for eight tasks a core. A row holds two blocks: one of them may be in memory at once.
    sides = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    with settings(
        spark,
        spark__sql__files__maxPartitionBytes=SIDE,
        spark__sql__files__minPartitionNum=sides,
        spark__sql__files__openCostInBytes=1 << 16,
        spark__sql__execution__arrow__maxRecordsPerBatch=1,
    ):
        return stage(rows.mapInArrow(joined, "class_id long, n long, a long, b long"), "vector-links")


def class_links(rows: DataFrame, dims: int, cosine: float, leading: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(class_id, h1, h2) of all vectors, (class_id, n) counts of linked vectors in other classes, and (a, b) edges that connect linked classes."""
    spark = rows.sparkSession
    eps = float(np.sqrt(max(1e-12, 2 - 2 * cosine)))
    n, grid = _principal(rows, dims, min(leading, dims), cosine, eps)
    size = n * dims * np.dtype(grid.kind).itemsize
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / PART))
    bands = min(BANDS, math.ceil(size / BAND))
    # A block in a row group, since readers take a row group into memory.
    blocks = stage(_sequence(rows, grid, parts, bands), "vector-blocks", by="band", parquet__block__row__count__limit=1, parquet__enable__dictionary="false")
    meeting = _meeting_bands(*_boxes(blocks), eps)
    links = reduce(DataFrame.unionByName, [_band_links(blocks, band, others, grid, cosine) for band, others in meeting.items()])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h1, h2 = (np.frombuffer(row[c], np.int64) for c in ("h1", "h2"))
                ids = row["first"] + np.arange(len(h1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h1), pa.array(h2)], ["class_id", "h1", "h2"])

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=16):
        classes = stage(blocks.select("first", "h1", "h2").mapInArrow(numbered, "class_id long, h1 long, h2 long"), "vector-classes")
    return (
        classes,
        links.where("class_id IS NOT NULL").groupBy("class_id").agg(F.sum("n").alias("n")),
        links.where("a IS NOT NULL").select("a", "b").distinct(),
    )


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = 0.9,
    leading: int = 8,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows link where the cosine of their vectors, in double precision, is at least
    ``cosine``. n_links counts the other rows linked directly; component_id is the
    smallest id that links reach, its own included; kept marks that id.

    Vectors that are null, empty or zero, or hold a null, NaN or infinite
    component, link with nothing. Shorter vectors count as filled up with zeros.
    Equal vectors are joined once, with their number, so copies cost nothing.
    Repeated rows are vectors of their own that link with each other. A null id
    is never the smallest; kept is false for it. Other columns are not read.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(vector_col)).schema[0].dataType
    kind = "float" if isinstance(given, T.ArrayType) and given.elementType == T.FloatType() else "double"  # kept as given, if single
    numbers = F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    source = vectors.select(F.col(id_col).alias("id"), numbers.alias("vector"))
    limit = F.lit(float("inf"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("vector", lambda x: x != 0)
    marked = source.withColumn("usable", F.coalesce(usable, F.lit(False)))
    marked = marked.select("id", "usable", *[F.when(F.col("usable"), c).alias(name) for name, c in (
        ("vector", F.col("vector")),
        ("h1", F.xxhash64("vector")),
        ("h2", F.xxhash64(F.lit(1), "vector")),
    )])
    # Shuffles of a job go when it ends: only one copy of the vectors in motion beside those written.
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        marked = stage(marked, "vectors", parquet__enable__dictionary="false")
        good = marked.where("usable")
        alone = marked.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        dims = good.agg(F.max(F.size("vector"))).first()[0]
        linked = _with_components(good, dims, cosine, leading) if dims else alone.limit(0)
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _with_components(good: DataFrame, dims: int, cosine: float, leading: int) -> DataFrame:
    """(id, n_links, component_id) of the rows whose vectors can link."""
    classes, counts, edges = class_links(good.select("h1", "h2", "vector"), dims, cosine, leading)
    found = connected_components(edges).select(F.col("node").alias("class_id"), "component")
    links = stage(counts.join(found, "class_id", "left"), "class-links")
    copies = good.groupBy("h1", "h2").agg(F.count("*").alias("many"), F.min("id").alias("first"))
    known = stage(
        classes.join(copies, ["h1", "h2"])
        .join(links, "class_id", "left")
        .select("h1", "h2", "first", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component"),
        "class-components",
    )
    together = known.where("component IS NOT NULL")
    least = together.groupBy("component").agg(F.min("first").alias("component_id"))
    together = together.join(stage(least, "component-ids"), "component").select("h1", "h2", "n_links", "component_id")
    single = known.where("component IS NULL").select("h1", "h2", "n_links", F.col("first").alias("component_id"))
    known = stage(together.unionByName(single), "class-results")
    # Both sides come from files: a vector with a third of all rows is split by adaptive execution.
    return good.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component_id")
