"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.llm.tables import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.select(F.col("v").alias("x"), "u").unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("u")))
    least = both.groupBy("x").agg(F.min("u").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("m"))
    joined = edges.join(stage(least, "least"), "v")
    return joined.select("u", F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(stage(least, "least"), "u")
    moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes that have an edge to another node.

    ``component`` is the smallest node that edges reach. Alternating large and
    small stars: each round is two aggregations and two joins on written tables,
    and the number of edges never grows. Only a count and a checksum come to the
    driver. Edges with a null end, loops and repeated edges are ignored.
    """
    ends = [F.col(a), F.col(b)]
    pairs = edges.where(ends[0].isNotNull() & ends[1].isNotNull())
    pairs = pairs.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).where("u > v").distinct()
    current = stage(pairs, "edges")
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        current = stage(_small_star(stage(_large_star(current), "edges")), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
