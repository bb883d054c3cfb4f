"""Samples, train/test splits and folds that do not change between runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The prime 2^31 - 1, and that prime over the golden ratio.
PRIME = 2_147_483_647
SPREAD = 1_327_217_885


def sample_fraction(df: DataFrame, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """Bernoulli sample without replacement."""
    return df.sample(False, fraction, seed)


def random_split(df: DataFrame, train: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``randomSplit`` with a seed. Its parts depend on how rows lie in partitions."""
    return tuple(df.randomSplit([train, 1.0 - train], seed))


def key_fraction(df: DataFrame, key: str | Sequence[str] | None = None, seed: int = 0) -> Column:
    """A number in [0, 1) per row that depends on the key and the seed alone.

    A single integer key is mixed by plain arithmetic; other keys, or the whole
    row when there is none, go through ``xxhash64`` first. A row recomputed
    after a lost executor falls on the same side again.
    """
    names = df.columns if key is None else [key] if isinstance(key, str) else list(key)
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, T.IntegralType):
        whole = F.coalesce(F.col(names[0]).cast("long"), F.lit(0).cast("long"))
    else:
        whole = F.xxhash64(*names)
    prime = F.lit(PRIME).cast("long")
    spread = F.pmod(F.pmod(whole, prime) * F.lit(SPREAD).cast("long") + F.lit(seed % PRIME), prime)
    return F.pmod(spread * spread, prime) / F.lit(float(PRIME))


def hash_split(
    df: DataFrame, key: str | Sequence[str] | None = None, train: float = 0.7, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Train and test part by key. Two filters over the same scan, no shuffle."""
    part = key_fraction(df, key, seed)
    return df.filter(part < train), df.filter(part >= train)


def kfold(
    df: DataFrame, folds: int, key: str | Sequence[str] | None = None, seed: int = 1, fold_col: str = "fold"
) -> DataFrame:
    """Add a fold number from 0 to ``folds - 1``, by key."""
    return df.withColumn(fold_col, F.floor(key_fraction(df, key, seed) * folds).cast("int"))


# --------------------------------------------------- exact sizes, by key hash

# Hex digits that a round of counting looks at, and rows that are sorted at the end at most.
DIGITS, SORTED_ROWS = 3, 50_000


def key_mark(df: DataFrame, key: str | Sequence[str] | None = None, seed: int = 0) -> Column:
    """md5 of seed and key as hex text: orders rows at random, the same on every run and in any partitioning."""
    names = df.columns if key is None else [key] if isinstance(key, str) else list(key)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _kth_mark(marks: DataFrame, k: int) -> tuple[str, int]:
    """The k-th smallest mark (from 1), and how many marks are below it.

    Each round counts the rows by the next digits of their mark, among those that
    share the digits found so far: 4,096 groups, whatever the table.
    """
    prefix, below = "", 0
    while True:
        inside = marks.where(F.col("mark").startswith(prefix)) if prefix else marks
        digits = F.substring("mark", len(prefix) + 1, DIGITS)
        counts = sorted((r["d"], r["n"]) for r in inside.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect())
        for found, n in counts:
            if below + n >= k:
                break
            below += n
        prefix += found
        if n <= SORTED_ROWS or len(prefix) >= 32:
            break
    last = marks.where(F.col("mark").startswith(prefix)).orderBy("mark").limit(k - below)
    row = last.agg(F.max("mark").alias("mark"), F.count("*").alias("n")).first()
    same = last.where(F.col("mark") == row["mark"]).count()
    return row["mark"], below + row["n"] - same


def bottom_k(df: DataFrame, k: int, key: str | Sequence[str] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(taken, rest): the k rows whose keys have the smallest marks, and all others.

    The sample has exactly k rows (all, if there are fewer), and is the same for
    any partitioning and after a lost executor. Both parts are filters of the
    table; only where rows share the mark at the border are these put in an order
    of their own, by a hash of the row.
    """
    marked = df.withColumn("mark", key_mark(df, key, seed))
    if k <= 0 or k >= df.count():
        everything, nothing = df, df.where(F.lit(False))
        return (nothing, everything) if k <= 0 else (everything, nothing)
    marks = marked.select("mark")
    border, below = _kth_mark(marks, k)
    taken, rest = marked.where(F.col("mark") < border), marked.where(F.col("mark") > border)
    ties = marked.where(F.col("mark") == border)
    if ties.count() == k - below:
        return marked.where(F.col("mark") <= border).drop("mark"), rest.drop("mark")
    row = F.xxhash64(*df.columns)
    first = ties.withColumn("row", row).orderBy("row", *df.columns).limit(k - below).drop("row")
    return taken.unionByName(first).drop("mark"), rest.unionByName(ties.exceptAll(first)).drop("mark")


def sample_exact(df: DataFrame, fraction: float = 0.8, key: str | Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """A sample without replacement of exactly the fraction of the rows, rounded."""
    return bottom_k(df, math.floor(fraction * df.count() + 0.5), key, seed)[0]


def split_exact(
    df: DataFrame, train: float = 0.7, key: str | Sequence[str] | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Train and test part with exactly the fraction of the rows, rounded, in the first."""
    return bottom_k(df, math.floor(train * df.count() + 0.5), key, seed)
