"""

Every query runs over whole tables of the given folder. ``events`` serves as the
stream of readings (time, value, user, k), with gaps put into its messages by a
rule on the event id; ``lineitem`` serves as the history for the regressors.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.functions import calendar as cal
from gapcast.operators import binning, correlation, metrics, profile, quality, quantiles, scoring, split, tuning
from gapcast.operators.isotonic import isotonic_steps_of
from gapcast.operators.models import POINT, WEIGHT, FittedModel, distinct_points, fit_model
from gapcast.operators.registry import ModelRegistry
from gapcast.plans.correlation import correlation_report
from gapcast.plans.imputation import complete_readings, route_messages, score_by_label, stage_by_label
from gapcast.plans.regression import analyse_gap, run_regression
from gapcast.schema import numeric_columns
from gapcast.scratch import shared_dir
from gapcast.sources import readings as src
from gapcast.sources import sinks, topic
from gapcast.sources.kafka import read_stream_raw
from gapcast.streaming.impute import stream_impute

ENTRY_DIR = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ inputs

READING = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("user_id", T.DoubleType()),
        T.StructField("k", T.DoubleType()),
    ]
)
READING_FIELDS = ("value", "user_id", "k")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flat readings with an epoch-millisecond column."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        cal.epoch_millis(F.col("ts")).alias("timestamp"),
        "value",
        F.col("user_id").cast("double").alias("user_id"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def value_gap_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages whose value is missing in three of seven, in the three ways."""
    turn = F.col("event_id") % 7
    value = F.when(turn == 0, "null").when(turn == 1, '""').when(turn == 2, '"undefined"').otherwise(_text("value"))
    return _messages(event_readings(spark, sf_dir), value, _text("user_id"), _text("k"))


def field_gap_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in which another field is missing each time."""
    turn = F.col("event_id") % 11
    return _messages(
        event_readings(spark, sf_dir),
        F.when(turn == 0, "null").otherwise(_text("value")),
        F.when(turn == 2, '"undefined"').otherwise(_text("user_id")),
        F.when(turn == 1, '""').otherwise(_text("k")),
    )


def mixed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with every kind of gap and defect."""
    turn = F.col("event_id") % 13
    good = _messages(
        event_readings(spark, sf_dir),
        F.when(turn.isin(0, 1), "null").otherwise(_text("value")),
        F.when(turn == 1, '""').otherwise(_text("user_id")),
        F.when(turn == 3, '"abc"').otherwise(_text("k")),
        F.when(turn == 2, '"undefined"').otherwise(_text("timestamp")),
        F.when(turn == 6, ',"battery":null').otherwise(""),
    )
    return good.withColumn(
        "value",
        F.when(turn == 4, F.expr("substring(value, 1, length(value) - 1)"))
        .when(turn == 5, F.concat(F.lit("["), "value", F.lit("]")))
        .otherwise(F.col("value")),
    )


def _messages(df, value, user_id, k, timestamp=None, extra=None) -> DataFrame:
    parts = [
        F.lit('{"value":'),
        value,
        F.lit(',"user_id":'),
        user_id,
        F.lit(',"k":'),
        k,
        F.lit(',"timestamp":'),
        _text("timestamp") if timestamp is None else timestamp,
        F.lit("") if extra is None else extra,
        F.lit("}"),
    ]
    return df.select("event_id", F.concat(*parts).alias("value"))


def routed(messages: DataFrame) -> DataFrame:
    return route_messages(messages, READING)


def gapped_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed readings of the value-gap messages: null where the value is missing."""
    return routed(value_gap_messages(spark, sf_dir)).select("event_id", *READING.names)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``signal``, a label that depends on the quantity."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "signal", F.col("l_quantity") * 400 + F.col("l_extendedprice") / 10
    )


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The 70/30 split of line items by order."""
    return split.hash_split(df, "l_orderkey", 0.7, seed=7)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zero."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


# ------------------------------------------------------- sources and sinks


def csv_round_trip(spark, sf_dir):
    path = shared_dir(spark, "csv")
    sinks.write_history_csv(event_readings(spark, sf_dir), path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), *READING.fields])
    return src.read_history_csv(spark, path, schema)


def json_round_trip(spark, sf_dir):
    path = shared_dir(spark, "json")
    sinks.write_reading_json(gapped_readings(spark, sf_dir), path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), *READING.fields])
    return src.read_reading_json(spark, path, schema)


def json_multiline(spark, sf_dir):
    """Pretty-printed readings, a thousand to a file."""
    path = shared_dir(spark, "multiline")
    record = F.to_json(F.struct("event_id", *READING.names), {"pretty": "true", "ignoreNullFields": "false"})
    files = event_readings(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 1000)).agg(F.collect_list(record).alias("records"))
    text = F.concat(F.lit("[\n"), F.array_join("records", ",\n"), F.lit("\n]"))
    files.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), *READING.fields])
    readings = src.read_reading_json(spark, path, schema, multiline=True, corrupt="bad")
    return src.split_corrupt(readings, "bad")[0]


def parquet_round_trip(spark, sf_dir):
    path = shared_dir(spark, "history")
    sinks.write_history(event_readings(spark, sf_dir), path)
    return src.read_history_parquet(spark, path)


def decode_message(spark, sf_dir):
    return gapped_readings(spark, sf_dir)


def preview_top5(spark, sf_dir):
    df = event_readings(spark, sf_dir).select("event_id", "value", "k")
    return sinks.preview(df, [F.desc("value"), "event_id"], 5)


# ---------------------------------------------- projections and predicates


def detect_missing(spark, sf_dir):
    found = routed(field_gap_messages(spark, sf_dir))
    return found.select("event_id", "label", F.size("missing").alias("n_missing"))


def detect_missing_all(spark, sf_dir):
    found = routed(mixed_messages(spark, sf_dir)).filter(F.col("payload").isNotNull())
    return found.select("event_id", F.array_join("missing", ",").alias("missing"))


def route_counts(spark, sf_dir):
    return routed(mixed_messages(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


def rejects(spark, sf_dir):
    return quality.collect_bad_input(routed(mixed_messages(spark, sf_dir))).select("event_id", "reason")


def rejects_non_finite(spark, sf_dir):
    """Texts that convert to no finite number."""
    turn = F.col("event_id") % 7
    user = F.when(turn == 0, '"NaN"').when(turn == 1, '"Infinity"').when(turn == 2, '"-Infinity"').otherwise(_text("user_id"))
    value = F.when(F.col("event_id") % 2 == 0, "null").otherwise(_text("value"))
    messages = _messages(event_readings(spark, sf_dir), value, user, _text("k"))
    return quality.collect_bad_input(routed(messages)).select("event_id", "reason")


def _text_label(spark, sf_dir):
    turn = F.col("event_id") % 7
    text = F.when(turn == 1, "").when(turn == 2, "undefined").when(turn > 2, F.col("value").cast("string"))
    return event_readings(spark, sf_dir).select("event_id", text.alias("value"), "k")


def cast_label(spark, sf_dir):
    return quality.cast_label_double(_text_label(spark, sf_dir), "value")


def fill_label(spark, sf_dir):
    return quality.fill_label(cast_label(spark, sf_dir), "value")


def drop_and_select(spark, sf_dir):
    df = quality.drop_columns(event_readings(spark, sf_dir), "timestamp", "user_id")
    return quality.select_columns(df, "k", "value", "event_id")


def numeric_only(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select(*numeric_columns(df, strict_types=True))


# ------------------------------------------------------------------ calendar


def calendar_features(spark, sf_dir):
    return cal.calendar_features(event_readings(spark, sf_dir)).drop("user_id", "k")


def calendar_features_zone(spark, sf_dir):
    df = event_readings(spark, sf_dir).select("event_id", "timestamp")
    return cal.calendar_features(df, tz="Asia/Tokyo", as_int=True)


def epoch_format(spark, sf_dir):
    seconds = cal.ms_to_seconds(F.col("timestamp"))
    text = cal.format_epoch(seconds)
    return event_readings(spark, sf_dir).select(
        "event_id", seconds.alias("seconds"), text.alias("at"), F.hour(cal.parse_timestamp(text)).alias("hour")
    )


def hour_range_counts(spark, sf_dir):
    df = cal.calendar_features(event_readings(spark, sf_dir))
    return df.groupBy("month", "day", "hour_range").agg(F.count("*").alias("n"))


# ---------------------------------------------------- profile, aggregations

LINE_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def describe_numeric(spark, sf_dir):
    described = profile.describe_all(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return rounded(described.drop("unique", "top", "freq", "first", "last"))


def describe_lineitem(spark, sf_dir):
    """Every column of a table: numbers, texts and a timestamp."""
    return rounded(profile.describe_all(table(spark, sf_dir, "lineitem")))


def describe_with_gaps(spark, sf_dir):
    described = profile.describe_all(gapped_readings(spark, sf_dir), READING_FIELDS)
    return rounded(described.drop("unique", "top", "freq", "first", "last"))


def describe_text(spark, sf_dir):
    described = profile.describe_all(table(spark, sf_dir, "documents"), ["text", "lang", "source"])
    return described.select("column", "count", "unique", "top", "freq")


def describe_orders(spark, sf_dir):
    return rounded(profile.describe_all(table(spark, sf_dir, "orders")))


def quartiles(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = quantiles.exact_quantiles(df, LINE_NUMBERS)
    rows = [(c, *q) for c, q in found.items()]
    return rounded(spark.createDataFrame(rows, "column string, q25 double, q50 double, q75 double"))


def quartiles_approximate(spark, sf_dir):
    found = quantiles.approx_quantiles(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return spark.createDataFrame(
        [(c, *q) for c, q in found.items()], "column string, q25 double, q50 double, q75 double"
    )


def corr_with_label(spark, sf_dir):
    return rounded(correlation.corr_with_label(gapped_readings(spark, sf_dir), "value", READING_FIELDS), 8)


def corr_with_label_drop(spark, sf_dir):
    df = gapped_readings(spark, sf_dir)
    return rounded(correlation.corr_with_label(df, "value", READING_FIELDS, nulls="drop"), 8)


def pair_density(spark, sf_dir):
    return binning.scatter_pairs(table(spark, sf_dir, "lineitem"), LINE_NUMBERS, bins=10)


def pair_density_with_gaps(spark, sf_dir):
    return binning.scatter_pairs(gapped_readings(spark, sf_dir), READING_FIELDS, bins=10)


def histograms_with_gaps(spark, sf_dir):
    return rounded(binning.histograms(gapped_readings(spark, sf_dir), READING_FIELDS, bins=10))


def histograms(spark, sf_dir):
    return rounded(binning.histograms(table(spark, sf_dir, "lineitem"), LINE_NUMBERS, bins=10))


def rmse_eval(spark, sf_dir):
    """Error of the plain guess k against the value."""
    return rounded(metrics.regression_metrics(event_readings(spark, sf_dir), "value", "k"))


# ------------------------------------------------------ samples and splits


def sample_fraction(spark, sf_dir):
    return split.sample_fraction(table(spark, sf_dir, "orders"), 0.8, seed=3)


def random_split_counts(spark, sf_dir):
    train, test = split.random_split(table(spark, sf_dir, "orders"), 0.7, seed=3)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


def sample_exact(spark, sf_dir):
    """Exactly four fifths of the orders, chosen by a hash of their key."""
    return split.sample_exact(table(spark, sf_dir, "orders"), 0.8, "o_orderkey", seed=3).select("o_orderkey", "o_custkey")


def split_exact(spark, sf_dir):
    train, test = split.split_exact(table(spark, sf_dir, "orders"), 0.7, "o_orderkey", seed=3)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("o_orderkey", "part")


def _tallies(**parts: DataFrame) -> DataFrame:
    """Per order key, how many rows each of some parts of the orders has."""
    tagged = [
        df.select("o_orderkey", *[F.lit(int(name == other)).alias(other) for other in parts]) for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, tagged).groupBy("o_orderkey").agg(*[F.sum(name).alias(name) for name in parts])


def sample_properties(spark, sf_dir):
    """The 80 % sample is part of the table and has the share asked for, within five deviations."""
    orders = table(spark, sf_dir, "orders")
    tallies = _tallies(whole=orders, part=split.sample_fraction(orders, 0.8, seed=3))
    whole, part = F.sum("whole"), F.sum("part")
    return tallies.agg(
        F.bool_and(F.col("part") <= F.col("whole")).alias("is_part"),
        (F.abs(part - 0.8 * whole) <= 5 * F.sqrt(0.16 * whole)).alias("share_holds"),
        F.bool_and(F.col("part") <= 1).alias("no_repeats"),
    )


def random_split_properties(spark, sf_dir):
    """Both parts together are the table, and they share no row."""
    orders = table(spark, sf_dir, "orders")
    train, test = split.random_split(orders, 0.7, seed=3)
    return _tallies(all=orders, train=train, test=test).agg(
        F.bool_and((F.col("train") == 0) | (F.col("test") == 0)).alias("disjoint"),
        F.bool_and(F.col("train") + F.col("test") == F.col("all")).alias("whole"),
    )


def quartiles_approximate_error(spark, sf_dir):
    """Approximate quartiles lie within 1 / accuracy of the ranks asked for."""
    df = table(spark, sf_dir, "lineitem")
    found = quantiles.approx_quantiles(df, LINE_NUMBERS)
    checks = []
    for c in LINE_NUMBERS:
        for p, value in zip((0.25, 0.5, 0.75), found[c]):
            below, upto = (F.avg((op(F.col(c), value)).cast("double")) for op in (Column.__lt__, Column.__le__))
            checks.append(((below <= p + 0.0002) & (upto >= p - 0.0002)).alias(f"{c}_{int(100 * p)}"))
    row = df.agg(*checks)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{q}").alias(f"q{q}_holds") for q in (25, 50, 75)]) for c in LINE_NUMBERS
    ])).alias("r")).select("r.*")


def hash_split_counts(spark, sf_dir):
    train, test = split.hash_split(table(spark, sf_dir, "orders"), "o_orderkey", 0.7, seed=7)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rounded(
        both.groupBy("part").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))
    )


def fold_counts(spark, sf_dir):
    df = split.kfold(table(spark, sf_dir, "orders"), 5, "o_orderkey", seed=11)
    return df.groupBy("fold").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("max_key"))


# ------------------------------------------------------------------ models


def _coefficients(spark, fitted: FittedModel) -> DataFrame:
    values = [float(c) for c in fitted.model.coefficients]
    rows = [*zip(fitted.features, values), ("intercept", float(fitted.model.intercept))]
    return spark.createDataFrame(rows, "term string, weight double")


def linear_fit(spark, sf_dir):
    train, _ = halves(lineitem(spark, sf_dir))
    return rounded(_coefficients(spark, fit_model("linear", train, ["l_quantity", "l_discount"], "signal")), 5)


def linear_predict(spark, sf_dir):
    train, test = halves(lineitem(spark, sf_dir))
    fitted = fit_model("linear", train, ["l_quantity", "l_discount"], "signal")
    return rounded(scoring.predict(fitted, test).select("l_orderkey", "l_linenumber", "signal", "prediction"))


def training_metrics(spark, sf_dir):
    train, _ = halves(lineitem(spark, sf_dir))
    fitted = fit_model("linear", train, ["l_quantity", "l_discount"], "signal")
    m = fitted.metrics
    return rounded(
        spark.createDataFrame([(m["train_rmse"], m["train_r2"])], "train_rmse double, train_r2 double"), 6
    )


ELASTIC = [(0.1, 0.0), (50.0, 0.5), (500.0, 1.0)]


def elastic_net_fit(spark, sf_dir):
    """Three penalties on one feature; each fit reads the table through its moments."""
    df = lineitem(spark, sf_dir)
    grid = {"regParam": [r for r, _ in ELASTIC], "elasticNetParam": [a for _, a in ELASTIC]}
    rows = []
    for reg, alpha in zip(*grid.values()):
        model = fit_model("linear", df, ["l_quantity"], "signal", {"regParam": reg, "elasticNetParam": alpha}).model
        rows.append((reg, alpha, float(model.coefficients[0]), float(model.intercept)))
    return rounded(
        spark.createDataFrame(rows, "reg_param double, elastic_net double, weight double, intercept double")
    )


STUMP = {"maxDepth": 1, "maxBins": 64}


def _by_quantity(df: DataFrame, fitted: FittedModel) -> DataFrame:
    """Prediction per quantity, with the number of rows it holds for."""
    scored = scoring.predict(fitted, df.select("l_quantity", fitted.label))
    return rounded(scored.groupBy("l_quantity", "prediction").agg(F.count("*").alias("n")))


def tree_stump(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return _by_quantity(df, fit_model("decision_tree", df, ["l_quantity"], "signal", STUMP))


def tree_rules(spark, sf_dir):
    """The two conditions of a one-split tree, as text."""
    df = lineitem(spark, sf_dir)
    rules = scoring.tree_dump(spark, fit_model("decision_tree", df, ["l_quantity"], "signal", STUMP))
    return rules.filter(F.col("rule").contains("l_quantity")).select("line", F.trim("rule").alias("rule"))


def gbt_two_rounds(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return _by_quantity(df, fit_model("gbt", df, ["l_quantity"], "signal", {**STUMP, "maxIter": 2}))


PLAIN_FOREST = {**STUMP, "numTrees": 3, "bootstrap": False, "featureSubsetStrategy": "all"}


def forest_no_bootstrap(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return _by_quantity(df, fit_model("random_forest", df, ["l_quantity"], "signal", PLAIN_FOREST))


def forest_bootstrap(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    params = {"maxDepth": 3, "maxBins": 32, "numTrees": 5, "seed": 1}
    return _by_quantity(df, fit_model("random_forest", df, ["l_quantity"], "signal", params))


def isotonic_fit(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return _by_quantity(df, fit_model("isotonic", df, ["l_quantity"], "l_extendedprice"))


def isotonic_ranges(spark, sf_dir):
    """Level stretches of order prices by month, pooled in ranges of eight months and merged."""
    months = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    points = distinct_points(table(spark, sf_dir, "orders").withColumn("month", months), "month", "o_totalprice")
    return rounded(isotonic_steps_of(points, POINT, "o_totalprice", WEIGHT, range_points=8).select("low", "high", "weight", "mean"))


def isotonic_decreasing(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return _by_quantity(df, fit_model("isotonic", df, ["l_quantity"], "l_extendedprice", {"isotonic": False}))


def isotonic_steps(spark, sf_dir):
    """Boundaries of the increasing fit: the ends of each level stretch."""
    df = lineitem(spark, sf_dir)
    fitted = fit_model("isotonic", df, ["l_quantity"], "l_extendedprice")
    return rounded(scoring.isotonic_steps(spark, fitted).select("boundary", "prediction"))


def feature_importance(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    fitted = fit_model("decision_tree", df, ["l_quantity", "l_discount"], "signal", STUMP)
    return rounded(scoring.feature_importance(spark, fitted))


def feature_importance_gbt(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    features = ["l_quantity", "l_discount", "l_tax"]
    fitted = fit_model("gbt", df, features, "signal", {"maxDepth": 3, "maxBins": 32, "maxIter": 3})
    return scoring.feature_importance(spark, fitted)


# ------------------------------------------------------ tuning, comparison

CV_GRID = {"regParam": [0.0, 50.0, 500.0], "elasticNetParam": [0.0, 0.5]}


def _linear_cv(spark, sf_dir) -> tuning.TuningResult:
    df = split.kfold(lineitem(spark, sf_dir), 5, "l_orderkey", seed=11)
    return tuning.cross_validate("linear", df, ["l_quantity"], "signal", CV_GRID, fold_col="fold")


def cv_mean_rmse(spark, sf_dir):
    result = _linear_cv(spark, sf_dir)
    rows = [
        (p["regParam"], p["elasticNetParam"], r) for p, r in zip(result.points, result.mean_rmse)
    ]
    return rounded(spark.createDataFrame(rows, "reg_param double, elastic_net double, mean_rmse double"), 5)


def best_grid_point(spark, sf_dir):
    result = _linear_cv(spark, sf_dir)
    best = result.points[result.best_point]
    row = (best["regParam"], float(result.best.model.coefficients[0]), float(result.best.model.intercept))
    return rounded(spark.createDataFrame([row], "reg_param double, weight double, intercept double"))


def cv_isotonic(spark, sf_dir):
    df = split.kfold(lineitem(spark, sf_dir), 5, "l_orderkey", seed=11)
    result = tuning.cross_validate("isotonic", df, ["l_quantity"], "signal", fold_col="fold")
    rows = [(p["isotonic"], r) for p, r in zip(result.points, result.mean_rmse)]
    return rounded(spark.createDataFrame(rows, "isotonic boolean, mean_rmse double"))


def cv_decision_tree(spark, sf_dir):
    df = split.kfold(lineitem(spark, sf_dir), 2, "l_orderkey", seed=11)
    grid = {"maxDepth": [1], "maxBins": [64]}
    result = tuning.cross_validate("decision_tree", df, ["l_quantity"], "signal", grid, 2, fold_col="fold")
    return rounded(result.table(spark).select("point", "mean_rmse", "best"))


def cv_tree_grid(spark, sf_dir):
    """Several depths from one fit per fold."""
    df = split.kfold(lineitem(spark, sf_dir), 2, "l_orderkey", seed=11)
    grid = {"maxDepth": [0, 1], "maxBins": [64]}
    result = tuning.cross_validate("decision_tree", df, ["l_quantity"], "signal", grid, 2, fold_col="fold")
    return rounded(result.table(spark).select("point", "mean_rmse", "best"))


def cv_forest_grid(spark, sf_dir):
    """Several depths and numbers of trees from one fit per fold; without draws all trees are the same."""
    df = split.kfold(lineitem(spark, sf_dir), 2, "l_orderkey", seed=11)
    grid = {"maxDepth": [0, 1], "maxBins": [64], "numTrees": [1, 3], "bootstrap": [False], "featureSubsetStrategy": ["all"]}
    result = tuning.cross_validate("random_forest", df, ["l_quantity"], "signal", grid, 2, fold_col="fold")
    return rounded(result.table(spark).select("point", "mean_rmse"))


def cv_gbt(spark, sf_dir):
    df = split.kfold(lineitem(spark, sf_dir), 2, "l_orderkey", seed=11)
    grid = {"maxDepth": [1], "maxBins": [64], "maxIter": [1, 2]}
    result = tuning.cross_validate("gbt", df, ["l_quantity"], "signal", grid, 2, fold_col="fold")
    return rounded(result.table(spark).select("point", "mean_rmse", "best"))


def cv_random_forest(spark, sf_dir):
    df = split.kfold(lineitem(spark, sf_dir), 2, "l_orderkey", seed=11)
    grid = {"maxDepth": [2, 4], "maxBins": [40], "numTrees": [5]}
    return tuning.cross_validate("random_forest", df, ["l_quantity"], "signal", grid, fold_col="fold").table(spark)


def _five_models(train: DataFrame) -> list[FittedModel]:
    params = {
        "decision_tree": STUMP,
        "gbt": {**STUMP, "maxIter": 2},
        "random_forest": PLAIN_FOREST,
    }
    return tuning.fit_all(train, ["l_quantity"], "signal", params)


def model_comparison(spark, sf_dir):
    train, test = halves(lineitem(spark, sf_dir))
    return rounded(tuning.model_comparison(_five_models(train), test).drop("params"))


def save_load_predict(spark, sf_dir):
    """The stump again, from its saved copy."""
    df = lineitem(spark, sf_dir)
    registry = ModelRegistry(spark, shared_dir(spark, "models"))

    def train() -> FittedModel:
        return fit_model("decision_tree", df, ["l_quantity"], "signal", STUMP)

    registry.train_or_load("decision_tree", "signal", ["l_quantity"], train)
    return _by_quantity(df, registry.load("decision_tree", "signal"))


def regression_run(spark, sf_dir):
    """Split, tune, save, score: test error of the tuned linear model."""
    history = lineitem(spark, sf_dir).select("l_orderkey", "l_quantity", "signal")
    registry = ModelRegistry(spark, shared_dir(spark, "models"))
    run = run_regression(
        history, "signal", "linear", registry, timestamp=None, key="l_orderkey", seed=7, grid={"regParam": [0.0]}
    )
    return rounded(spark.createDataFrame([(run.rmse,)], "rmse double"))


# --------------------------------------------------------------- imputation


@contextmanager
def _parsed_once(routed_df: DataFrame, fields: list[str]):
    """Fields of the complete readings, kept while a fit scans them twice: the messages are parsed in the first scan."""
    complete = complete_readings(routed_df).select(*fields).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield complete
    finally:
        complete.unpersist()


def _value_model(routed_df: DataFrame) -> FittedModel:
    with _parsed_once(routed_df, ["user_id", "k", "value"]) as complete:
        return fit_model("linear", complete, ["user_id", "k"], "value")


def predict_missing(spark, sf_dir):
    """From raw messages to readings without gaps: parse once, train, fill."""
    staged = stage_by_label(routed(value_gap_messages(spark, sf_dir)), shared_dir(spark, "staged"))
    filled, _ = score_by_label(staged, {"value": [_value_model(staged)]}, READING)
    return rounded(filled.select("event_id", "value", "imputed"))


def predict_missing_table(spark, sf_dir):
    """The same on typed readings with null values."""
    df = gapped_readings(spark, sf_dir)
    fitted = fit_model("linear", df, ["user_id", "k"], "value")
    return rounded(scoring.predict_missing(fitted, df).select("event_id", "value", "imputed"))


LABEL_FEATURES = {"value": ["user_id", "k"], "k": ["value", "user_id"], "user_id": ["value", "k"]}


def _field_models(routed_df: DataFrame) -> dict[str, list[FittedModel]]:
    with _parsed_once(routed_df, list(LABEL_FEATURES)) as complete:
        return {label: [fit_model("linear", complete, fs, label)] for label, fs in LABEL_FEATURES.items()}


def predict_by_label(spark, sf_dir):
    """Gaps in several fields, each filled by the model of its field."""
    staged = stage_by_label(routed(field_gap_messages(spark, sf_dir)), shared_dir(spark, "staged"))
    filled, _ = score_by_label(staged, _field_models(staged), READING)
    return rounded(filled.select("event_id", "label", "value", "user_id", "k"))


def _run_stream(spark, messages, models, path) -> DataFrame:
    sinks.write_raw_messages(_with_event_id(messages), f"{path}/in")
    _finish(_impute(read_stream_raw(spark, f"{path}/in"), _registry(spark, models, path), path))
    return spark.read.parquet(f"{path}/out")


def _registry(spark, models, path) -> ModelRegistry:
    registry = ModelRegistry(spark, f"{path}/models")
    for fitted in models.values():
        registry.save(fitted[0])
    return registry


def _with_event_id(messages) -> DataFrame:
    """The messages with their event id as one more field."""
    head, event = F.expr("substring(value, 1, length(value) - 1)"), F.col("event_id").cast("string")
    return messages.select(F.concat(head, F.lit(',"event_id":'), event, F.lit("}")).alias("value"))


def _impute(stream, registry, path, trigger=None):
    schema = T.StructType([*READING.fields, T.StructField("event_id", T.LongType())])
    folders = (f"{path}/{name}" for name in ("out", "checkpoint", "rejects"))
    return stream_impute(stream, registry, "linear", *folders, schema=schema, trigger=trigger)


def stream_topic_resume(spark, sf_dir):
    """A stream that starts at the latest offsets of a topic, stops, and goes on from its checkpoint.

    A third of the messages is there before the start, a third comes while the
    stream runs, the rest while it is stopped: the last two thirds are filled.
    """
    messages = value_gap_messages(spark, sf_dir)
    path = shared_dir(spark, "topic")
    registry = _registry(spark, {"value": [_value_model(routed(messages))]}, path)
    parts = [_with_event_id(messages.where(F.col("event_id") % 3 == i)) for i in range(3)]
    topic.create_topic(spark, f"{path}/topic", 4)
    topic.append_to_topic(parts[0], f"{path}/topic")
    query = _impute(topic.read_stream_topic(spark, f"{path}/topic", "latest"), registry, path, {"processingTime": "0 seconds"})
    query.processAllAvailable()
    topic.append_to_topic(parts[1], f"{path}/topic")
    query.processAllAvailable()
    query.stop()
    topic.append_to_topic(parts[2], f"{path}/topic")
    _finish(_impute(topic.read_stream_topic(spark, f"{path}/topic", "latest"), registry, path))
    return rounded(spark.read.parquet(f"{path}/out").select("event_id", "value", "imputed"))


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_impute_values(spark, sf_dir):
    """The messages of ``predict_missing`` as a stream."""
    messages = value_gap_messages(spark, sf_dir)
    models = {"value": [_value_model(routed(messages))]}
    filled = _run_stream(spark, messages, models, shared_dir(spark, "stream"))
    return rounded(filled.select("event_id", "value", "imputed"))


def stream_rejects(spark, sf_dir):
    """Why messages of a stream were turned away."""
    path = shared_dir(spark, "stream")
    registry = ModelRegistry(spark, f"{path}/models")
    registry.save(_value_model(routed(mixed_messages(spark, sf_dir))))
    sinks.write_raw_messages(mixed_messages(spark, sf_dir), f"{path}/in")
    messages = read_stream_raw(spark, f"{path}/in")
    folders = (f"{path}/{name}" for name in ("out", "checkpoint", "rejects"))
    _finish(stream_impute(messages, registry, ["linear"], *folders, schema=READING))
    return spark.read.parquet(f"{path}/rejects").groupBy("reason").agg(F.count("*").alias("n"))


def stream_score_by_label(spark, sf_dir):
    messages = field_gap_messages(spark, sf_dir)
    filled = _run_stream(spark, messages, _field_models(routed(messages)), shared_dir(spark, "stream"))
    return rounded(filled.select("event_id", "label", "value", "user_id", "k"))


# ------------------------------------------------------------------ reports


def correlation_report_corr(spark, sf_dir):
    """Correlations of the report: readings with calendar columns, value as label."""
    report = correlation_report(event_readings(spark, sf_dir).drop("event_id"), "value")
    return rounded(report.correlations, 8)


def gap_report(spark, sf_dir):
    """All five regressors for one label, on readings with calendar features."""
    history = event_readings(spark, sf_dir).drop("event_id")
    grids = {
        "linear": {"regParam": [0.001, 0.1], "elasticNetParam": [0.5]},
        "decision_tree": {"maxDepth": [2], "maxBins": [20]},
        "gbt": {"maxDepth": [2], "maxBins": [20], "maxIter": [2]},
        "random_forest": {"maxDepth": [3], "maxBins": [40], "numTrees": [3]},
    }
    registry = ModelRegistry(spark, shared_dir(spark, "models"))
    return analyse_gap(history, "value", registry, grids=grids).comparison


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Fill the gaps of all messages with a model of the complete ones."""
    return predict_missing(spark, ENTRY_DIR)


def _corpus_parts():
    """The modules of the training-data subpackage, or None where it was taken out of the library."""
    try:
        import corpus_pipeline
        from gapcast.llm import queries as llm_queries
        from gapcast.llm import sql as llm_sql
    except ModuleNotFoundError as e:
        if e.name in ("gapcast.llm", "corpus_pipeline"):
            return None
        raise
    return llm_queries, llm_sql, corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = _own_queries()
    if (parts := _corpus_parts()) is not None:
        registered |= parts[0].queries() | {"pipeline": parts[2].run}
    return registered


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "csv_round_trip": csv_round_trip,
        "json_round_trip": json_round_trip,
        "json_multiline": json_multiline,
        "parquet_round_trip": parquet_round_trip,
        "decode_message": decode_message,
        "preview_top5": preview_top5,
        "detect_missing": detect_missing,
        "detect_missing_all": detect_missing_all,
        "route_counts": route_counts,
        "rejects": rejects,
        "rejects_non_finite": rejects_non_finite,
        "cast_label": cast_label,
        "fill_label": fill_label,
        "drop_and_select": drop_and_select,
        "numeric_only": numeric_only,
        "calendar_features": calendar_features,
        "calendar_features_zone": calendar_features_zone,
        "epoch_format": epoch_format,
        "hour_range_counts": hour_range_counts,
        "describe_numeric": describe_numeric,
        "describe_lineitem": describe_lineitem,
        "describe_with_gaps": describe_with_gaps,
        "describe_text": describe_text,
        "describe_orders": describe_orders,
        "quartiles": quartiles,
        "quartiles_approximate": quartiles_approximate,
        "corr_with_label": corr_with_label,
        "corr_with_label_drop": corr_with_label_drop,
        "pair_density": pair_density,
        "pair_density_with_gaps": pair_density_with_gaps,
        "histograms": histograms,
        "histograms_with_gaps": histograms_with_gaps,
        "rmse_eval": rmse_eval,
        "sample_fraction": sample_fraction,
        "random_split_counts": random_split_counts,
        "sample_exact": sample_exact,
        "split_exact": split_exact,
        "sample_properties": sample_properties,
        "random_split_properties": random_split_properties,
        "quartiles_approximate_error": quartiles_approximate_error,
        "hash_split_counts": hash_split_counts,
        "fold_counts": fold_counts,
        "linear_fit": linear_fit,
        "linear_predict": linear_predict,
        "training_metrics": training_metrics,
        "elastic_net_fit": elastic_net_fit,
        "tree_stump": tree_stump,
        "tree_rules": tree_rules,
        "gbt_two_rounds": gbt_two_rounds,
        "forest_no_bootstrap": forest_no_bootstrap,
        "forest_bootstrap": forest_bootstrap,
        "isotonic_fit": isotonic_fit,
        "isotonic_ranges": isotonic_ranges,
        "isotonic_decreasing": isotonic_decreasing,
        "isotonic_steps": isotonic_steps,
        "feature_importance": feature_importance,
        "feature_importance_gbt": feature_importance_gbt,
        "cv_mean_rmse": cv_mean_rmse,
        "best_grid_point": best_grid_point,
        "cv_isotonic": cv_isotonic,
        "cv_decision_tree": cv_decision_tree,
        "cv_tree_grid": cv_tree_grid,
        "cv_forest_grid": cv_forest_grid,
        "cv_gbt": cv_gbt,
        "cv_random_forest": cv_random_forest,
        "model_comparison": model_comparison,
        "save_load_predict": save_load_predict,
        "regression_run": regression_run,
        "predict_missing": predict_missing,
        "predict_missing_table": predict_missing_table,
        "score_by_label": predict_by_label,
        "stream_impute": stream_impute_values,
        "stream_rejects": stream_rejects,
        "stream_topic_resume": stream_topic_resume,
        "stream_score_by_label": stream_score_by_label,
        "correlation_report": correlation_report_corr,
        "gap_report": gap_report,
    }


def oracle_sql() -> dict[str, str]:
    from oracles import oracle_sql as sql

    found = sql()
    if (parts := _corpus_parts()) is not None:
        found |= parts[1].oracle_sql()
        if parts[2].ORACLE_SQL is not None:
            found["pipeline"] = parts[2].ORACLE_SQL
    return found
