"""Column profile: what a describe of the whole table reports, aggregated in Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.operators.quantiles import ColumnRange, approx_quantiles, exact_quantiles, number
from gapcast.schema import date_columns, numeric_columns, text_columns
from gapcast.scratch import shared_dir

PROFILE_SCHEMA = (
    "column string, count long, unique long, top string, freq long, mean double, std double, "
    "min double, q25 double, q50 double, q75 double, max double, first string, last string"
)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Count, mean, sample deviation, minimum and maximum, in one aggregate over one scan."""
    if not columns:
        return {}
    types = dict(df.dtypes)
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(
        *[f(number(c, types[c])).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in measures.items()]
    ).first()
    return {c: {k: row[f"{k}{i}"] for k in measures} for i, c in enumerate(columns)}


def date_ends(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """First and last value of date and timestamp columns, as text."""
    if not columns:
        return {}
    ends = [f(c).cast("string").alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("first", F.min), ("last", F.max))]
    row = df.agg(*ends).first()
    return {c: {k: row[f"{k}{i}"] for k in ("first", "last")} for i, c in enumerate(columns)}


# Leading characters of a value that travel with its hash, and values of one column looked up by a sent list at most.
PREFIX, LOOKED_UP = 24, 10_000


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its count, per text column.

    Values are counted by a 128-bit hash, with their first letters to tell which of
    equally frequent ones comes first: what is shuffled does not grow with the
    length of the texts. Counts are combined before the shuffle, so a value that
    fills a third of the rows costs one row per task. A second scan looks up the
    texts of the winners. Ties go to the least value.
    """
    names = F.array(*[F.lit(c) for c in columns])

    def hashed(*also: str) -> DataFrame:
        values = df.select(F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("c", "value")).where("value IS NOT NULL")
        return values.select("c", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2"), F.substring("value", 1, PREFIX).alias("head"), *also)

    path = shared_dir(df.sparkSession, "value-counts")
    keys = ["c", "h1", "h2", "head"]
    hashed().groupBy(*keys).agg(F.count("*").alias("n")).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    rank = F.min(F.struct((-F.col("n")).alias("minus_n"), "head")).alias("top")
    totals = counts.groupBy("c").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), rank)
    # Of the most frequent values those with the least first letters: usually one a column, many if no value repeats.
    best = totals.select(F.col("c").alias("of"), "top")
    winners = counts.join(F.broadcast(best), (F.col("c") == F.col("of")) & (F.col("n") == -F.col("top.minus_n")) & (F.col("head") == F.col("top.head")))
    winners = winners.select(*keys)
    if winners.limit(LOOKED_UP + 1).count() <= LOOKED_UP:
        winners = F.broadcast(winners)
    top = hashed("value").join(winners, keys, "left_semi").groupBy("c").agg(F.min("value").alias("value"))
    return totals.join(top, "c").select(
        F.get(names, F.col("c")).alias("column"), "count", "unique", F.col("value").alias("top"), (-F.col("top.minus_n")).alias("freq")
    )


def describe_all(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """One row per column, in table order; only aggregates reach the driver.

    Numeric columns get mean, deviation, extremes and quartiles; text, date and
    timestamp columns get distinct count, top value and its frequency, dates also
    their first and last. Quartiles are exact unless ``approximate``. A column of
    another type is refused by name.
    """
    wanted = list(columns) if columns is not None else df.columns
    numeric = [c for c in numeric_columns(df) if c in wanted]
    dates = [c for c in date_columns(df) if c in wanted]
    text = [c for c in [*text_columns(df), *dates] if c in wanted]
    if other := [c for c in wanted if c not in (*numeric, *text)]:
        raise ValueError(f"no profile for the types of {other}")

    rows: dict[str, dict] = numeric_profile(df, numeric)
    if numeric and approximate:
        quartiles = approx_quantiles(df, numeric)
    else:
        ranges = {c: ColumnRange(r["count"], r["min"], r["max"]) for c, r in rows.items()}
        quartiles = exact_quantiles(df, numeric, ranges=ranges)
    for c, (q25, q50, q75) in quartiles.items():
        rows[c].update(q25=q25, q50=q50, q75=q75)
    if text:
        rows.update({c: {"count": 0, "unique": 0} for c in text})
        for r in text_profile(df, text).collect():  # one row per text column
            rows[r["column"]] = r.asDict()
        for c, ends in date_ends(df, dates).items():
            rows[c].update(ends)

    names = [part.split()[0] for part in PROFILE_SCHEMA.split(", ")]
    table = [tuple({"column": c, **rows[c]}.get(k) for k in names) for c in wanted if c in rows]
    return df.sparkSession.createDataFrame(table, PROFILE_SCHEMA)
