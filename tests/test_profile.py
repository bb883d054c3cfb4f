import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gapcast.operators import quantiles
from gapcast.plans.correlation import correlation_report
from gapcast.operators import profile
from gapcast.operators.binning import histograms, scatter_pairs
from gapcast.operators.correlation import corr_with_label
from gapcast.operators.profile import describe_all
from gapcast.operators.quantiles import approx_quantiles, column_ranges, exact_quantiles


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    rows = [
        (
            rng.gauss(10, 3) if i % 7 else None,
            rng.choice([1.5, 2.5, float("nan")]),
            rng.randrange(100),
            rng.choice(["a", "b", None]),
            i % 3 == 0,
        )
        for i in range(500)
    ]
    return spark.createDataFrame(rows, "x double, y double, n long, s string, flag boolean"), pd.DataFrame(
        rows, columns=["x", "y", "n", "s", "flag"]
    )


def test_describe_matches_pandas(mixed):
    df, pdf = mixed
    ours = {r["column"]: r for r in describe_all(df).collect()}
    theirs = pdf.astype({"s": object}).describe(include="all").transpose()
    assert list(ours) == ["x", "y", "n", "s", "flag"]
    for c in ("x", "y", "n"):
        for a, b in (("count",) * 2, ("mean",) * 2, ("std",) * 2, ("min",) * 2, ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max",) * 2):
            assert ours[c][a] == pytest.approx(theirs.loc[c, b], rel=1e-12), (c, a)
        assert ours[c]["top"] is None
    for c in ("s", "flag"):
        assert ours[c]["count"] == theirs.loc[c, "count"]
        assert ours[c]["unique"] == theirs.loc[c, "unique"]
        assert ours[c]["freq"] == theirs.loc[c, "freq"]
        assert ours[c]["mean"] is None


def test_ties_go_to_the_least_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    row = describe_all(df).first()
    assert (row["top"], row["freq"], row["unique"]) == ("a", 2, 3)


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None)], "x double, s string")
    x, s = describe_all(df).collect()
    assert x["count"] == 0 and x["mean"] is None and x["q50"] is None
    assert s["count"] == 0 and s["unique"] == 0 and s["top"] is None
    assert describe_all(df).first()["q50"] is None


PROBS = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)


def check_quantiles(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = exact_quantiles(df, ["v"], PROBS, bins=bins)["v"]
    expected = np.quantile(np.array(values), PROBS)
    assert found == pytest.approx(expected.tolist(), rel=1e-12, abs=1e-300)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40), st.sampled_from([2, 3, 16]))
def test_narrowing_finds_exact_quantiles(spark, values, bins):
    check_quantiles(spark, values, bins)


def test_narrowing_with_a_hot_value_and_outliers(spark):
    rng = random.Random(2)
    values = [20.5] * 400 + [rng.random() for _ in range(600)] + [1e300, -1e300, 5e-324]
    check_quantiles(spark, values, 64)


def test_narrowing_of_several_columns_at_once(spark, mixed):
    df, pdf = mixed
    found = exact_quantiles(df, ["x", "y", "n"], bins=8)
    for c in ("x", "y", "n"):
        assert found[c] == pytest.approx(pdf[c].quantile([0.25, 0.5, 0.75]).tolist(), rel=1e-12)


def count_rounds(monkeypatch):
    rounds, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *args: rounds.append(1) or narrow(*args))
    return rounds


@pytest.mark.parametrize(
    "values",
    [
        [float("-inf")] * 3 + [float(i) for i in range(3000)] + [float("inf")],
        [s * 10.0**e for e in range(-282, 283) for s in (-1, 1)] + [0.0],
        [5e-324 * i for i in range(1, 2000)] + [1.0],
        [1 + i * 2.0**-52 for i in range(3000)],
    ],
    ids=["infinities", "spread over logarithms", "least doubles", "neighbouring doubles"],
)
def test_rounds_are_bounded(spark, monkeypatch, values):
    rounds = count_rounds(monkeypatch)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    found = exact_quantiles(df, ["v"], (0.0, 0.3, 0.5, 1.0))["v"]
    ordered = sorted(values)
    for p, q in zip((0.0, 0.3, 0.5, 1.0), found):
        x = (len(ordered) - 1) * p
        low, high = ordered[math.floor(x)], ordered[math.ceil(x)]
        assert low == q == high or low <= q <= high
    assert len(rounds) <= quantiles.MAX_ROUNDS


def test_dates_are_profiled_and_unknown_types_refused(spark):
    df = spark.sql("SELECT 'w' AS t, date'2024-02-01' AS d UNION ALL SELECT 'x', date'2024-03-05' UNION ALL SELECT 'y', NULL")
    row = describe_all(df, ["d"]).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (2, 2, "2024-02-01", 1)
    assert (row["first"], row["last"], row["mean"]) == ("2024-02-01", "2024-03-05", None)
    with pytest.raises(ValueError, match="a"):
        describe_all(spark.sql("SELECT array(1) AS a"))


def test_infinities_are_in_the_end_bins(spark):
    values = [0.0, 1.0, 9.0, 10.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v, v) for v in values], "x double, y double")
    counts = {r["bin"]: r["n"] for r in histograms(df, ["x"], bins=10).collect()}
    assert counts[0] == 2 and counts[1] == 1 and counts[9] == 3 and sum(counts.values()) == 6
    assert scatter_pairs(df, bins=10).agg(F.sum("n")).first()[0] == 6


def test_a_report_with_infinities_has_finite_bins(spark):
    rows = [(float(i), float(i), None) for i in range(10)] + [(float("inf"), 3.0, None)]
    report = correlation_report(spark.createDataFrame(rows, "x double, y double, z double"), "y", timestamp=None)
    own = {r["bin"]: r for r in report.histograms.where("column = 'x'").collect()}
    assert [own[b]["n"] for b in range(10)] == [1] * 9 + [2]
    assert (own[0]["bin_low"], own[9]["bin_high"]) == (0.0, 9.0)
    assert report.pairs.agg(F.sum("n")).first()[0] == 11


def test_many_columns_and_bins_do_not_overflow(spark):
    df = spark.range(3).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(20)])
    found = scatter_pairs(df, bins=3000)
    assert found.agg(F.sum("n")).first()[0] == 3 * 190
    assert found.select("x", "y").distinct().count() == 190


def wide_table(spark):
    """60,000 rows: a hot value, ties, infinities, missing values, few values and one value."""
    x = F.col("id").cast("double")
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.sin(x) * F.exp(x / 3000)).alias("hot"),
        F.when(F.col("id") % 50 == 0, float("inf")).when(F.col("id") % 50 == 1, float("-inf")).otherwise(F.cos(x)).alias("infinite"),
        F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 1, None).otherwise(F.cbrt(x)).alias("missing"),
        (F.col("id") % 3).cast("int").alias("few"),
        F.lit(2.5).alias("one"),
        F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 40, x).alias("short"),
    )


@pytest.mark.parametrize("broken", [False, True])
def test_sketched_brackets_keep_quantiles_exact(spark, monkeypatch, broken):
    df = wide_table(spark)
    sketch = quantiles._sketch

    def wrong(*args):  # brackets that hold none of the ranks
        ranges, brackets = sketch(*args)
        return ranges, {c: [(-1e300, -1e299) for _ in b[:1]] for c, b in brackets.items()}

    if broken:
        monkeypatch.setattr(quantiles, "_sketch", wrong)
    probabilities = (0.0, 0.25, 0.5, 0.7501, 1.0)
    found = exact_quantiles(df, df.columns, probabilities)
    assert found == exact_quantiles(df, df.columns, probabilities, ranges=column_ranges(df, df.columns))
    rows = df.toPandas()
    for c in df.columns:
        values = np.sort(rows[c].dropna().to_numpy(float))
        if not len(values):
            assert found[c] == [None] * 5
            continue
        for p, q in zip(probabilities, found[c]):
            at = (len(values) - 1) * p
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            assert q == pytest.approx(low if low == high else low + (at - np.floor(at)) * (high - low), rel=1e-9)


def test_few_rounds_after_the_sketch(spark, monkeypatch):
    rounds, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *args: rounds.append(1) or narrow(*args))
    df = spark.range(200_000).select(F.sin(F.col("id").cast("double")).alias("v"), (F.exp(F.rand(3) * 9)).alias("w"))
    found = exact_quantiles(df, ["v", "w"])
    rows = df.toPandas()
    assert len(rounds) <= 2
    assert found["v"] == pytest.approx(np.quantile(rows["v"], [0.25, 0.5, 0.75]).tolist(), rel=1e-12)
    assert found["w"] == pytest.approx(np.quantile(rows["w"], [0.25, 0.5, 0.75]).tolist(), rel=1e-12)


def test_approximate_quantiles_are_close(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    for q, p in zip(approx_quantiles(df, ["v"])["v"], (0.25, 0.5, 0.75)):
        assert abs(q - p * 10_000) < 20


def test_correlation_null_rules(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 6.5), (4.0, 7.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    zero = {r["column"]: r["corr"] for r in corr_with_label(df, "a").collect()}
    drop = {r["column"]: r["corr"] for r in corr_with_label(df, "a", nulls="drop").collect()}
    full = pd.DataFrame(rows, columns=["a", "b"])
    assert zero["a"] == pytest.approx(1.0)
    assert zero["b"] == pytest.approx(df.stat.corr("a", "b"))
    assert zero["b"] == pytest.approx(full.fillna(0.0).corr().loc["a", "b"])
    assert drop["b"] == pytest.approx(full.corr().loc["a", "b"])
    with pytest.raises(ValueError):
        corr_with_label(df, "a", nulls="keep")


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5)], "a double, b int")
    assert {r["column"]: r["corr"] for r in corr_with_label(df, "a").collect()}["b"] is None


def test_correlation_takes_one_scan(spark, mixed):
    plan = corr_with_label(mixed[0], "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1


def test_histograms_match_numpy(mixed):
    df, pdf = mixed
    rows = histograms(df, ["x", "n"], bins=10).collect()
    for c in ("x", "n"):
        counts, edges = np.histogram(pdf[c].dropna(), bins=10)
        mine = sorted((r["bin"], r["n"], r["bin_low"], r["bin_high"]) for r in rows if r["column"] == c)
        assert [m[1] for m in mine] == counts.tolist()
        assert [m[2] for m in mine] == pytest.approx(edges[:-1].tolist())
        assert [m[3] for m in mine] == pytest.approx(edges[1:].tolist())


def test_constant_column_histogram(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    counts, edges = np.histogram([3.0, 3.0], bins=10)
    rows = sorted(histograms(df, bins=10).collect(), key=lambda r: r["bin"])
    assert [r["n"] for r in rows] == counts.tolist()
    assert [r["bin_low"] for r in rows] == pytest.approx(edges[:-1].tolist())


def test_pairs_match_numpy(mixed):
    df, pdf = mixed
    rows = [r for r in scatter_pairs(df, ["x", "y", "n"], bins=6).collect() if (r["x"], r["y"]) == ("x", "n")]
    pairs = pdf[["x", "n"]].dropna()
    limits = [[pdf[c].min(), pdf[c].max()] for c in ("x", "n")]
    counts, _, _ = np.histogram2d(pairs["x"], pairs["n"], bins=6, range=limits)
    mine = np.zeros((6, 6))
    for r in rows:
        mine[r["x_bin"], r["y_bin"]] = r["n"]
    assert (mine == counts).all()


def test_pairs_of_a_sample_are_fewer(mixed):
    df, _ = mixed
    ranges = column_ranges(df, ["x", "n"])
    full = scatter_pairs(df, ["x", "n"], ranges=ranges).agg(F.sum("n")).first()[0]
    part = scatter_pairs(df, ["x", "n"], ranges=ranges, fraction=0.5, seed=1).agg(F.sum("n")).first()[0]
    assert 0 < part < full
    assert not math.isnan(part)


def test_text_profile_of_long_and_equally_frequent_values(spark, monkeypatch):
    long = "x" * 100_000
    rows = [(long + "b", "p"), (long + "a", "p"), (long + "b", None), (long + "a", "q"), (None, ""), ("z", "")]
    df = spark.createDataFrame(rows, "t string, u string")
    for limit in (10_000, 0):  # winners sent to all tasks, or joined by hash
        monkeypatch.setattr(profile, "LOOKED_UP", limit)
        found = {r["column"]: tuple(r)[1:] for r in profile.text_profile(df, ["t", "u"]).collect()}
        assert found == {"t": (5, 3, long + "a", 2), "u": (5, 3, "", 2)}
    every = spark.createDataFrame([(f"{long}{i}",) for i in range(30)], "t string")
    assert tuple(profile.text_profile(every, ["t"]).first()) == ("t", 30, 30, f"{long}0", 1)


def test_text_profile_shuffles_no_texts(spark):
    df = spark.createDataFrame([("a" * 50,)], "t string")
    plan = profile.text_profile(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert all("value" not in line for line in plan.split("\n") if "Exchange hashpartitioning(c" in line and "head" in line)
