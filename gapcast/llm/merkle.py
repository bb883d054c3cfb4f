"""Merkle manifest of a table: a root for all rows, and for each row a witness that proves it.

Leaves of a group are laid in order and cut into aligned blocks. A task appends
the leaves of a block one by one to its open subtrees; a leaf has a partial
witness from the start, and every run of siblings that completes extends the
witnesses of all leaves below it. The roots of the blocks are the next appends,
again in aligned blocks, until one node is left for each group; the groups'
roots are appended likewise. A witness is extended downwards by one join per
tier of blocks. Hashes are sha256 over the lowercase hex text of the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.llm.tables import partitions, stage

WITNESS = "array<struct<left:binary,right:binary>>"
_ARROW_WITNESS = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def leaf_hash(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values: ``-`` for null, else UTF-8 byte count, a colon and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, values)), 256)


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf (hex text) and its witness lead to."""

    def up(node: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.lower(F.hex(step["left"])), node, F.lower(F.hex(step["right"]))), 256)

    return F.aggregate(witness, leaf, up)


def proof(witness: Column) -> Column:
    """All siblings of a witness, from the leaf up and from left to right, as one hex text."""
    return F.array_join(F.transform(witness, lambda w: F.lower(F.hex(F.concat(w["left"], w["right"])))), "")


def height(total: int, arity: int) -> int:
    """Levels above ``total`` nodes until one is left."""
    levels = 0
    while total > 1:
        total, levels = -(-total // arity), levels + 1
    return levels


class OpenSubtrees:
    """Aligned appends: nodes wait at their level until their run of siblings completes.

    ``witnesses[i]`` holds the siblings of the i-th node appended, level by level,
    as far as they are known. The runs left open complete with ``close``; the last
    node, ``height`` levels up, is ``root``.
    """

    def __init__(self, arity: int, height: int):
        self.arity, self.height = arity, height
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height)]
        self.witnesses: list[list[tuple[bytes, bytes]]] = []
        self.root: bytes | None = None

    def append(self, node: bytes) -> None:
        self.witnesses.append([])
        self._put(0, node, len(self.witnesses) - 1, len(self.witnesses))

    def close(self) -> None:
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)

    def _put(self, level: int, node: bytes, first: int, end: int) -> None:
        if level == self.height:
            self.root = node
            return
        self.open[level].append((node, first, end))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _, _ in run]
        for i, (_, first, end) in enumerate(run):
            siblings = b"".join(nodes[:i]), b"".join(nodes[i + 1 :])
            for witness in self.witnesses[first:end]:
                witness.append(siblings)
        parent = hashlib.sha256(b"".join(nodes).hex().encode()).digest()
        self._put(level + 1, parent, run[0][1], run[-1][2])


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``place`` (from 0, in its group by ``order``) and ``total`` (rows of the group).

    Range partitions of (group, order) are numbered as they lie; what each holds of
    a group is counted, and running sums of the counts are joined back. Nothing but
    these counts is brought together, and a group that holds most rows is split.
    """
    spark = df.sparkSession
    keys = [group, *order]
    dealt = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    laid = stage(dealt.withColumn("serial", F.monotonically_increasing_id()), "laid-leaves")
    part = F.shiftright("serial", 33)
    counts = laid.groupBy(part.alias("of_part"), F.col(group).alias("of_group")).agg(F.min("serial").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("of_group")
    before = F.coalesce(F.sum("n").over(own.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stage(counts.select("of_part", "of_group", "first", before.alias("before"), F.sum("n").over(own).alias("total")), "leaf-counts")
    joined = laid.join(counts, (part == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group")))
    return joined.select(*df.columns, (F.col("serial") - F.col("first") + F.col("before")).alias("place"), "total")


def _append_blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Witnesses within blocks, and block roots (rows without a witness; their place is the block).

    ``nodes`` has columns branch, place, total, node and any others, which the
    witness rows keep. ``total`` of a root counts the roots of its branch.
    """
    span = arity**levels
    block = F.floor(F.col("place") / F.lit(span)).cast("long")
    dealt = nodes.withColumn("block", block).repartition("branch", "block").sortWithinPartitions("branch", "block", "place")
    fields = [*dealt.schema.fields, T.StructField("witness", T._parse_datatype_string(WITNESS))]
    names = dealt.columns
    at = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        tree, key, kinds = None, None, None
        for batch in batches:
            kinds = batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if tree is None or (row[at["branch"]], row[at["block"]]) != key:
                    if rows:
                        yield from out(rows, tree, kinds)
                    key = row[at["branch"]], row[at["block"]]
                    rows, tree = [], OpenSubtrees(arity, min(levels, height(row[at["total"]], arity)))
                rows.append(row)
                tree.append(row[at["node"]])
        if rows:
            yield from out(rows, tree, kinds)

    def out(rows: list[tuple], tree: OpenSubtrees, kinds: list) -> Iterator[pa.RecordBatch]:
        tree.close()
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        steps = [s for w in tree.witnesses for s in w]
        sides = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], pa.binary()) for i in (0, 1)], ["left", "right"])
        ends = [0]
        for w in tree.witnesses:
            ends.append(ends[-1] + len(w))
        witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides)
        yield pa.RecordBatch.from_arrays([*columns, witness], [*names, "witness"])
        last = rows[-1]
        known = {"branch": last[at["branch"]], "place": last[at["block"]], "total": -(-last[at["total"]] // span), "node": tree.root}
        columns = [pa.array([known.get(n)], t) for n, t in zip(names, kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([None], _ARROW_WITNESS)], [*names, "witness"])

    return dealt.mapInArrow(run, T.StructType(fields))


def _tiers(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Written tables of witnesses and block roots, from the leaves up, until every branch has one root."""
    tiers = []
    while True:
        tiers.append(stage(_append_blocks(nodes, arity, levels), "merkle-tier"))
        above = tiers[-1].where("witness IS NULL AND total > 1")
        if above.isEmpty():
            return tiers
        nodes = above.select("branch", "place", "total", "node")


def _extended(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest tier with whole witnesses. ``tops`` has branch, top (its root) and rest (the witness of that root)."""
    above = None
    for number, tier in reversed(list(enumerate(tiers))):
        finished = tier.where("witness IS NULL AND total = 1").select(F.col("branch").alias("b"))
        parents = finished.join(tops, F.col("b").eqNullSafe(tops["branch"])).select(
            "b", F.lit(0).cast("long").alias("parent"), "top", "rest"
        )
        if above is not None:
            parents = parents.unionByName(above.select(F.col("branch").alias("b"), F.col("place").alias("parent"), "top", F.col("witness").alias("rest")))
        parents = stage(parents, "merkle-parents")
        joined = tier.where("witness IS NOT NULL").join(
            parents, F.col("branch").eqNullSafe(F.col("b")) & (F.col("block") == F.col("parent"))
        )
        kept = [c for c in tier.columns if c not in ("witness", "block")]
        above = joined.select(*kept, "top", F.concat("witness", "rest").alias("witness"))
        if number:
            above = stage(above, "merkle-tier-extended")
    return above


def merkle_manifest(
    rows: DataFrame,
    id_col: str,
    columns: list[str],
    group_col: str,
    carried: dict[str, Column] | None = None,
    arity: int = 8,
    levels: int = 4,
) -> DataFrame:
    """(id, group, leaf, subroot, root, witness) of every row, and ``carried`` columns.

    A leaf is the hash of ``columns``. In each group leaves ascend by id, and every
    ``arity`` consecutive nodes become their hash (the last run may be shorter)
    while there are several; a lone leaf is its own subroot. Subroots ascend by
    group, null first, and become the root in the same way. ``witness`` lists the
    siblings to the left and right, from the leaf up to the root: ``fold`` leads
    from leaf to root.

    Null ids come first. Rows that share an id follow each other by leaf; equal
    leaves are interchangeable. Repeated rows are leaves of their own. Null groups
    are a group. Columns other than those named are not read, and may have any
    name. Values are hashed as Spark casts them to text. An empty table has no
    rows and no root.
    """
    values = {"id": F.col(id_col), "branch": F.col(group_col), **(carried or {})}
    leaves = rows.select(*[c.alias(n) for n, c in values.items()], F.unhex(leaf_hash([F.col(c) for c in columns])).alias("node"))
    leaves = stage(leaves.withColumn("dealt", F.spark_partition_id()), "leaves")
    nodes = placed(leaves, "branch", ["id", "node", "dealt"]).drop("dealt")
    tiers = _tiers(nodes, arity, levels)
    roots = [t.where("witness IS NULL AND total = 1").select(F.col("branch").alias("group"), "node") for t in tiers]
    subroots = stage(reduce(DataFrame.unionByName, roots), "subroots").withColumn("branch", F.lit(0))
    tops = _tiers(placed(subroots, "branch", ["group"]), arity, levels)
    root = tops[-1].where("witness IS NULL AND total = 1").select("branch", F.col("node").alias("top"))
    whole = _extended(tops, root.withColumn("rest", F.array().cast(WITNESS)))
    groups = stage(whole.select(F.col("group").alias("branch"), F.col("node").alias("subroot"), "top", F.col("witness").alias("rest")), "groups")
    found = _extended(tiers, groups.select("branch", F.struct("subroot", "top").alias("top"), "rest"))
    text = {"leaf": "node", "subroot": "top.subroot", "root": "top.top"}
    return found.select(
        F.col("id").alias(id_col),
        F.col("branch").alias(group_col),
        *[F.lower(F.hex(c)).alias(n) for n, c in text.items()],
        "witness",
        *(carried or {}),
    )
