"""Exact quantiles of many columns with bounded memory per task.

Spark's ``percentile`` keeps every distinct value of a column in the one task
that finishes the aggregate. Here the ranks are located by narrowing, whatever
the size of the table: each round counts the values of the current bracket in
bins (map-side combined, a few thousand groups in all) and keeps the bin that
holds the rank, until a bracket is a single value. A bracket that spans orders of
magnitude, zero or an infinity is cut into bins of signed logarithms, any other
one into bins of equal width, so no data need more than MAX_ROUNDS rounds.

On all but small tables the first brackets come from a mergeable sketch, gathered
in the scan that finds the ranges. A count of the rows below and inside them proves
that they hold the wanted ranks; a column for which they do not starts from its
whole range. One round then ends it for a few hundred thousand rows, seldom two.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024
# With 1,024 bins: two rounds of logarithms at most, then six of ten bits each for the 52 bits of a mantissa.
MAX_ROUNDS = 8
WIDE = 1024.0
# The sketch is off by a 10,000th of the rows at most; brackets reach three times that to both sides.
# Columns of fewer values than SMALL, where the difference is a few ranks, start from the whole range.
ACCURACY, REACH, SMALL = 10_000, 0.0003, 20_000
# Signed logarithms are moved away from zero by this; -ln of the least positive double is below 745.
SHIFT, FARTHEST = 746.0, 1500.0


def number(name: str, dtype: str) -> Column:
    """The column as double, with NaN counted as missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value) if dtype in ("double", "float") else value


@dataclass(frozen=True)
class ColumnRange:
    count: int
    low: float | None
    high: float | None


def _range_aggregates(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    types = dict(df.dtypes)
    aggregates = []
    for i, c in enumerate(columns):
        value = number(c, types[c])
        aggregates += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    return aggregates


def column_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnRange]:
    """Count, minimum and maximum of every column, in one aggregate."""
    row = df.agg(*_range_aggregates(df, columns)).first()
    return {c: ColumnRange(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per row and column: ``c``, the column's place, and ``v``, its value.

    What follows is one small expression for all columns, with the bounds of a
    column looked up by ``c``. A separate expression per column would make code
    too long for the JVM to compile.
    """
    types = dict(df.dtypes)
    values = F.array(*[number(c, types[c]) for c in columns])
    return df.select(F.posexplode(values).alias("c", "v")).filter(F.col("v").isNotNull())


def lookup(values: Sequence, place: Column, dtype: str = "double") -> Column:
    """``values[place]`` out of a constant array."""
    return F.get(F.array(*[F.lit(v).cast(dtype) for v in values]), place)


def _log(x: float) -> float:
    """Signed logarithm of a bound; grows with it over all doubles."""
    if x == 0:
        return 0.0
    return math.copysign(FARTHEST if math.isinf(x) else math.log(abs(x)) + SHIFT, x)


def _log_column(x: Column) -> Column:
    size = F.when(F.abs(x) == float("inf"), F.lit(FARTHEST)).otherwise(F.log(F.abs(x)) + SHIFT)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * size)


def _is_wide(low: float, high: float) -> bool:
    return low <= 0 <= high or math.isinf(low) or math.isinf(high) or max(high / low, low / high) > WIDE


def _bin(value: Column, low: Column, high: Column, wide: Column, bins: int) -> Column:
    """Bin of a value between two bounds; the top bin holds exactly ``high``.

    For a wide bracket the bounds are signed logarithms.
    """
    scaled = F.when(wide, _log_column(value)).otherwise(value)
    share = F.least(F.greatest((scaled - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.least((F.nanvl(share, F.lit(0.0)) * (bins - 1)).cast("int"), F.lit(bins - 2))


def _narrow(df: DataFrame, brackets: Sequence[tuple], bins: int) -> list:
    """One round: for every (bracket, rank) the bin that holds it.

    The brackets of one column do not overlap, so a value is in one at most.
    """
    by_column: dict[str, list] = {}
    ranks = []
    for i, ((column, low, high), wanted) in enumerate(brackets):
        by_column.setdefault(column, []).append((i, low, high))
        ranks += [F.lit(i), F.array(*[F.lit(r).cast("long") for r in wanted])]

    code = F.lit(None).cast("int")
    for k in range(max(map(len, by_column.values()))):
        kth = [places[k] if k < len(places) else (None, None, None) for places in by_column.values()]
        bracket = lookup([i for i, _, _ in kth], F.col("c"), "int")
        low, high = (lookup(edge, F.col("c")) for edge in zip(*[(lo, hi) for _, lo, hi in kth]))
        wides = [lo is not None and _is_wide(lo, hi) for _, lo, hi in kth]
        ends = [(lo, hi) if lo is None or not w else (_log(lo), _log(hi)) for w, (_, lo, hi) in zip(wides, kth)]
        from_, to = (lookup(edge, F.col("c")) for edge in zip(*ends))
        inside = F.col("v").between(low, high)
        top = F.col("v") == high
        inner = _bin(F.col("v"), from_, to, lookup(wides, F.col("c"), "boolean"), bins)
        place = F.when(top, F.lit(bins - 1)).otherwise(inner)
        code = F.when(inside, bracket * bins + place).otherwise(code)
    counts = (
        cells(df, list(by_column))
        .select(code.alias("code"), "v")
        .filter(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    upto = F.sum("n").over(W.partitionBy("bracket").orderBy("code"))
    return (
        counts.withColumn("bracket", F.floor(F.col("code") / bins).cast("int"))
        .withColumn("upto", upto)
        .withColumn("rank", F.explode(F.create_map(*ranks)[F.col("bracket")]))
        .filter((F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")))
        .select("bracket", "rank", "low", "high", "n", (F.col("upto") - F.col("n")).alias("skipped"))
        .collect()  # one row per bracket and rank
    )


def _sketch(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], ranges: Mapping[str, ColumnRange] | None
) -> tuple[Mapping[str, ColumnRange], dict[str, list[tuple[float, float]]]]:
    """The ranges of the columns, unless given, and the sketch's brackets of every probability, in one scan."""
    types = dict(df.dtypes)
    ends = [min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-REACH, REACH)]
    marks = [F.percentile_approx(number(c, types[c]), ends, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]
    row = df.agg(*marks, *([] if ranges else _range_aggregates(df, columns))).first()
    found = ranges or {c: ColumnRange(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    brackets = {}
    for i, c in enumerate(columns):
        apart: list[tuple[float, float]] = []
        for low, high in sorted(zip((row[f"q{i}"] or [])[::2], (row[f"q{i}"] or [])[1::2])):
            if apart and low <= apart[-1][1]:
                before = apart.pop()
                low, high = before[0], max(high, before[1])
            apart.append((low, high))
        brackets[c] = apart
    return found, brackets


def _counted(df: DataFrame, brackets: Mapping[str, list[tuple[float, float]]]) -> dict[str, list[tuple]]:
    """Every bracket with the ranks it holds: (low, high, first rank, rank after the last)."""
    columns = list(brackets)
    many = max(map(len, brackets.values()))
    aggregates = []
    for k in range(many):
        low, high = (lookup([b[k][end] if k < len(b) else None for b in brackets.values()], F.col("c")) for end in (0, 1))
        aggregates += [F.count_if(F.col("v") < low).alias(f"first{k}"), F.count_if(F.col("v") <= high).alias(f"end{k}")]
    rows = {r["c"]: r for r in cells(df, columns).groupBy("c").agg(*aggregates).collect()}  # one per column
    return {
        c: [(*b, rows[i][f"first{k}"], rows[i][f"end{k}"]) for k, b in enumerate(brackets[c])] for i, c in enumerate(columns)
    }


def _values_at_ranks(
    df: DataFrame,
    wanted: Mapping[str, set[int]],
    ranges: Mapping[str, ColumnRange],
    bins: int,
    brackets: Mapping[str, list[tuple]],
) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    # open[(column, low, high)] = {absolute rank: rank inside the bracket}
    open_: dict[tuple, dict[int, int]] = {}

    def settle(column, rank, inside, low, high):
        if low == high:
            found[(column, rank)] = low
        else:
            open_.setdefault((column, low, high), {})[rank] = inside

    for c, ranks in wanted.items():
        held = {r: b for r in ranks for b in brackets.get(c, ()) if b[2] <= r < b[3]}
        whole = (ranges[c].low, ranges[c].high, 0, ranges[c].count)
        for r in ranks:
            low, high, first, _ = held[r] if len(held) == len(ranks) else whole
            settle(c, r, r - first, low, high)
    while open_:  # at most MAX_ROUNDS rounds with the default bins
        work = [(key, sorted(inside.items())) for key, inside in open_.items()]
        rows = _narrow(df, [(key, sorted({i for _, i in items})) for key, items in work], bins)
        place = {(row["bracket"], row["rank"]): row for row in rows}
        open_ = {}
        for b, ((column, _, _), items) in enumerate(work):
            for rank, inside in items:
                row = place[(b, inside)]
                at, low, high = inside - row["skipped"], row["low"], row["high"]
                if at == 0:
                    high = low
                elif at == row["n"] - 1:
                    low = high
                settle(column, rank, at, low, high)
    return found


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    ranges: Mapping[str, ColumnRange] | None = None,
    bins: int = BINS,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbours, per column."""
    if not columns:
        return {}
    if ranges and max(ranges[c].count for c in columns) < SMALL:
        brackets = {}
    else:
        ranges, brackets = _sketch(df, columns, probabilities, ranges)
    brackets = {c: b for c, b in brackets.items() if ranges[c].count >= SMALL}
    held = _counted(df, brackets) if brackets else {}
    position = {
        c: [(ranges[c].count - 1) * p for p in probabilities] for c in columns if ranges[c].count > 0
    }
    wanted = {c: {r for x in pos for r in (math.floor(x), math.ceil(x))} for c, pos in position.items()}
    at = _values_at_ranks(df, wanted, ranges, bins, held)

    def interpolate(c: str, x: float) -> float:
        lower, upper = math.floor(x), math.ceil(x)
        if lower == upper or at[(c, lower)] == at[(c, upper)]:
            return at[(c, lower)]
        return (upper - x) * at[(c, lower)] + (x - lower) * at[(c, upper)]

    return {
        c: [interpolate(c, x) for x in position[c]] if c in position else [None] * len(probabilities)
        for c in columns
    }


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """One-pass sketch quantiles, rank error below 1/accuracy."""
    types = dict(df.dtypes)
    row = df.agg(
        *[
            F.percentile_approx(number(c, types[c]), list(probabilities), accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: row[f"q{i}"] or [None] * len(probabilities) for i, c in enumerate(columns)}
