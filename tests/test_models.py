import json
import random

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import functions as F

from gapcast.operators import scoring
from gapcast.operators.features import assemble_features
from gapcast.operators.isotonic import condensed, isotonic_steps_of
from gapcast.operators.metrics import regression_metrics, rmse
from gapcast.operators.models import (
    SPECS,
    TREES,
    assembled_rows,
    fit_linear,
    fit_model,
    grid_points,
    make_estimator,
)
from gapcast.operators.moments import collect_moments, linear_sse
from gapcast.operators.registry import ModelRegistry
from gapcast.operators.split import kfold
from gapcast.operators.flat_models import FlatSteps, flat_trees, predict_by_key, truncated_errors
from gapcast.operators.tuning import cross_validate, cross_validator, fit_all, model_comparison

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        a, b, c = rng.uniform(0, 10), rng.gauss(1000, 5), float(rng.randrange(4))
        data.append((i, a, b, c, 3 * a - 0.5 * b + c * c + rng.gauss(0, 0.5)))
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double").repartition(4).persist()


# ------------------------------------------------------------------- grids


def test_grid_sizes(spark):
    sizes = {name: len(grid_points(name)) for name in SPECS}
    assert sizes == {"linear": 150, "isotonic": 2, "decision_tree": 25, "gbt": 27, "random_forest": 27}
    fits = sum(n * SPECS[a].folds + 1 for a, n in sizes.items())
    assert fits == 1079


def test_grid_order_is_that_of_the_builder(spark):
    validator = cross_validator("gbt", "y")
    maps = [{p.name: v for p, v in m.items()} for m in validator.getEstimatorParamMaps()]
    assert maps == grid_points("gbt")
    assert validator.getNumFolds() == 5 and validator.getParallelism() == 3
    forest = cross_validator("random_forest", "y")
    assert forest.getNumFolds() == 2 and forest.getParallelism() == 2


def test_deep_trees_keep_node_ids(spark):
    assert make_estimator("decision_tree", "y", {"maxDepth": 30}).getCacheNodeIds()
    assert not make_estimator("decision_tree", "y", {"maxDepth": 5}).getCacheNodeIds()


# ----------------------------------------------------------------- moments


def test_moments_match_numpy(rows):
    columns = [*FEATURES, "y"]
    table = np.array([list(r) for r in rows.select(*columns).collect()])
    m = collect_moments(rows, columns)[0]
    assert m.n == 600
    assert np.allclose(m.mean, table.mean(axis=0), rtol=1e-12)
    assert np.allclose(m.scatter / m.n, np.cov(table.T, bias=True), rtol=1e-10, atol=1e-12)


def test_fold_moments_add_up(rows):
    columns = [*FEATURES, "y"]
    folded = collect_moments(kfold(rows, 3, "id"), columns, by="fold")
    whole = collect_moments(rows, columns)[0]
    total = folded[0] + folded[1] + folded[2]
    assert total.n == whole.n
    assert np.allclose(total.mean, whole.mean) and np.allclose(total.scatter, whole.scatter)


def test_moments_refuse_gaps(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, y double")
    with pytest.raises(ValueError, match="'y'"):
        collect_moments(df, ["a", "y"])
    nan = spark.createDataFrame([(1.0, float("nan")), (2.0, 3.0)], "a double, y double")
    with pytest.raises(ValueError, match="'y'"):
        collect_moments(nan, ["a", "y"])


@pytest.mark.parametrize(
    "params",
    [
        {},
        {"regParam": 0.1},
        {"regParam": 0.5, "elasticNetParam": 0.5},
        {"regParam": 2.0, "elasticNetParam": 1.0, "maxIter": 5},
        {"regParam": 0.01, "elasticNetParam": 0.25, "maxIter": 1},
        {"regParam": 0.1, "standardization": False},
        {"fitIntercept": False},
    ],
)
def test_fit_from_moments_is_the_fit_on_rows(rows, params):
    compact = fit_linear(rows, FEATURES, "y", params, method="moments")
    plain = fit_linear(rows, FEATURES, "y", params, method="rows")
    assert np.allclose(compact.model.coefficients, plain.model.coefficients, rtol=1e-7, atol=1e-9)
    assert compact.model.intercept == pytest.approx(plain.model.intercept, rel=1e-7, abs=1e-7)
    assert compact.metrics["train_rmse"] == pytest.approx(plain.metrics["train_rmse"], rel=1e-8)
    if params.get("fitIntercept", True):
        assert compact.metrics["train_r2"] == pytest.approx(plain.metrics["train_r2"], rel=1e-8)


def test_fit_with_a_constant_and_a_doubled_feature(rows):
    df = rows.withColumn("k", F.lit(7.0)).withColumn("a2", F.col("a") * 2)
    features = ["a", "k", "a2", "c"]
    params = {"regParam": 0.1}
    compact = fit_linear(df, features, "y", params, method="moments")
    plain = fit_linear(df, features, "y", params, method="rows")
    assert np.allclose(compact.model.coefficients, plain.model.coefficients, rtol=1e-6, atol=1e-8)


def test_sse_from_moments(rows):
    m = collect_moments(rows, [*FEATURES, "y"])[0]
    coefficients, intercept = np.array([3.0, -0.4, 2.0]), -30.0
    scored = rows.withColumn("prediction", F.col("a") * 3 - F.col("b") * 0.4 + F.col("c") * 2 - 30)
    assert np.sqrt(linear_sse(m, coefficients, intercept) / m.n) == pytest.approx(rmse(scored, "y"), rel=1e-9)


# -------------------------------------------------------------------- fits


def test_isotonic_from_distinct_points(spark, rows):
    df = rows.withColumn("g", F.floor("a").cast("double"))
    for up in (True, False):
        compact = fit_model("isotonic", df, ["g", "b"], "y", {"isotonic": up}).model
        plain = make_estimator("isotonic", "y", {"isotonic": up}).fit(assembled_rows(df, ["g", "b"], "y"))
        assert np.allclose(compact.boundaries, plain.boundaries)
        assert np.allclose(compact.predictions, plain.predictions)


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "outliers", "steps"])
@pytest.mark.parametrize("up", [True, False])
def test_distributed_pooling_equals_mllib(spark, shape, up):
    rng = np.random.default_rng(len(shape))
    x = np.arange(3000) / 7
    y = {"noise": x + rng.normal(0, 40, 3000), "falling": -x, "rising": x, "steps": np.floor(x / 50) + 0.0, "outliers": x * 1.0}[shape]
    if shape == "outliers":
        y[[5, 1500, 2999]] = [1e5, -1e5, -1e6]
    rows = [(float(a), float(b), float(w)) for a, b, w in zip(x, y, rng.integers(1, 5, 3000))]
    points = spark.createDataFrame(rows, "x double, y double, w double").repartition(5)
    steps = isotonic_steps_of(points, "x", "y", "w", up, range_points=170).orderBy("low").collect()
    assert all((a["mean"] < b["mean"]) == up and a["high"] < b["low"] for a, b in zip(steps, steps[1:]))
    plain = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", isotonic=up).fit(points)
    own = np.concatenate([np.full(sum(s["low"] <= v <= s["high"] for v in x), s["mean"]) for s in steps])
    theirs = np.array([r["prediction"] for r in plain.transform(points.orderBy("x")).collect()])
    assert own == pytest.approx(theirs, rel=1e-9, abs=1e-9)
    short = condensed(points, "x", "y", "w", up, range_points=170)
    model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", isotonic=up).fit(short)
    assert np.array([r["prediction"] for r in model.transform(points.orderBy("x")).collect()]) == pytest.approx(theirs, rel=1e-9, abs=1e-9)
    assert sum(r["w"] for r in short.collect()) == pytest.approx(sum(r[2] for r in rows))


def test_pooling_of_one_and_no_points(spark):
    one = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, w double")
    assert [tuple(r) for r in isotonic_steps_of(one, "x", "y", "w").collect()] == [(1.0, 1.0, 3.0, 2.0)]
    assert isotonic_steps_of(one.where("x > 1"), "x", "y", "w").count() == 0


def test_isotonic_on_another_feature(rows):
    fitted = fit_model("isotonic", rows, ["b", "a"], "y", {"featureIndex": 1})
    by_name = fit_model("isotonic", rows, ["a", "b"], "y")
    x = scoring.predict(fitted, rows).select("id", "prediction")
    y = scoring.predict(by_name, rows).select("id", "prediction")
    assert x.exceptAll(y).count() == 0


def test_plain_forest_is_the_tree(rows):
    params = {"maxDepth": 4, "maxBins": 64}
    tree = fit_model("decision_tree", rows, FEATURES, "y", params)
    forest = fit_model(
        "random_forest", rows, FEATURES, "y", {**params, "numTrees": 2, "bootstrap": False, "featureSubsetStrategy": "all"}
    )
    both = scoring.predict(forest, scoring.predict(tree, rows, "p1"), "p2")
    assert both.filter(F.abs(F.col("p1") - F.col("p2")) > 1e-9).count() == 0


def test_one_round_of_boosting_is_the_tree(rows):
    params = {"maxDepth": 3, "maxBins": 64}
    tree = fit_model("decision_tree", rows, FEATURES, "y", params)
    gbt = fit_model("gbt", rows, FEATURES, "y", {**params, "maxIter": 1})
    both = scoring.predict(gbt, scoring.predict(tree, rows, "p1"), "p2")
    assert both.filter(F.abs(F.col("p1") - F.col("p2")) > 1e-9).count() == 0


@pytest.mark.parametrize("algorithm", TREES)
def test_importances_add_up(spark, rows, algorithm):
    params = {"maxDepth": 3, "seed": 1, **({"numTrees": 3} if algorithm == "random_forest" else {})}
    if algorithm == "gbt":
        params["maxIter"] = 2
    table = scoring.feature_importance(spark, fit_model(algorithm, rows, FEATURES, "y", params)).collect()
    assert [r["feature"] for r in table] == FEATURES
    assert all(r["importance"] >= 0 for r in table)
    assert sum(r["importance"] for r in table) == pytest.approx(1.0)


def test_rules_name_the_features(spark, rows):
    fitted = fit_model("decision_tree", rows, FEATURES, "y", {"maxDepth": 2})
    text = "\n".join(r["rule"] for r in scoring.tree_dump(spark, fitted).orderBy("line").collect())
    assert "feature " not in text and "If (a <=" in text and "Predict:" in text


def test_isotonic_steps_are_sorted(spark, rows):
    steps = scoring.isotonic_steps(spark, fit_model("isotonic", rows, ["a"], "y")).orderBy("step").collect()
    assert [s["boundary"] for s in steps] == sorted(s["boundary"] for s in steps)
    assert [s["prediction"] for s in steps] == sorted(s["prediction"] for s in steps)


def test_unlabelled_rows_do_not_train(spark, rows):
    extra = spark.createDataFrame([(1000, 1.0, 1.0, 1.0, None)], rows.schema)
    a = fit_model("linear", rows.unionAll(extra), FEATURES, "y").model
    b = fit_model("linear", rows, FEATURES, "y").model
    assert np.allclose(a.coefficients, b.coefficients)


def test_rows_with_empty_features_raise_or_are_skipped(spark, rows):
    extra = spark.createDataFrame([(1000, None, 1.0, 1.0, 1.0)], rows.schema)
    for algorithm in SPECS:
        with pytest.raises(Exception, match="(?i)null"):
            fit_model(algorithm, rows.unionAll(extra), FEATURES, "y")
    a = fit_model("linear", rows.unionAll(extra), FEATURES, "y", handle_invalid="skip").model
    assert np.allclose(a.coefficients, fit_model("linear", rows, FEATURES, "y").model.coefficients)


def test_five_hundred_columns_in_tiles(spark):
    """Moments and a grid on many columns, against numpy and a fit on the rows."""
    rng = np.random.default_rng(8)
    width, n = 500, 1500
    x = rng.normal(rng.uniform(-50, 50, width), rng.uniform(0.1, 9, width), (n, width))
    y = x @ rng.normal(size=width) + rng.normal(size=n)
    columns = [f"c{i}" for i in range(width)]
    wide = spark.createDataFrame([(i % 2, row.tolist(), float(v)) for i, (row, v) in enumerate(zip(x, y))], "fold int, x array<double>, y double")
    df = wide.select("fold", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)]).repartition(5).persist()
    moments = collect_moments(df, [*columns, "y"], by="fold")
    both = np.column_stack([x, y])
    for fold in (0, 1):
        own = both[fold::2]
        assert moments[fold].n == len(own) and np.allclose(moments[fold].mean, own.mean(axis=0))
        assert np.allclose(moments[fold].scatter, np.cov(own.T) * (len(own) - 1), rtol=1e-8, atol=1e-6)
    fitted = fit_linear(df, columns, "y", {"regParam": 0.0}, method="moments")
    expected = np.linalg.lstsq(np.column_stack([x, np.ones(n)]), y, rcond=None)[0]
    assert np.allclose(fitted.model.coefficients.toArray(), expected[:-1], atol=1e-6)
    found = cross_validate("linear", df, columns, "y", {"regParam": [0.0, 0.1]}, 2, fold_col="fold")
    assert found.best.params == {"regParam": 0.0} and 1.0 < found.mean_rmse[0] < 4.0
    df.unpersist()


# ------------------------------------------------------------------ tuning

GRIDS = {
    "linear": {"regParam": [0.001, 0.5], "elasticNetParam": [0.0, 0.5], "maxIter": [1, 20]},
    "isotonic": {"isotonic": [True, False]},
    "gbt": {"maxDepth": [2, 3], "maxBins": [20], "maxIter": [1, 3]},
    "decision_tree": {"maxDepth": [0, 1, 3, 8], "maxBins": [8, 32]},
}


@pytest.mark.parametrize("algorithm", GRIDS)
def test_short_cuts_equal_the_plain_search(rows, algorithm):
    df = kfold(rows, 3, "id")
    args = (algorithm, df, FEATURES, "y", GRIDS[algorithm], 3)
    fast = cross_validate(*args, fold_col="fold")
    plain = cross_validate(*args, fold_col="fold", method="rows")
    assert fast.points == plain.points
    assert fast.mean_rmse == pytest.approx(plain.mean_rmse, rel=1e-7)
    assert fast.best.params == plain.best.params
    a = scoring.predict(fast.best, rows, "p1")
    both = scoring.predict(plain.best, a, "p2")
    assert both.filter(F.abs(F.col("p1") - F.col("p2")) > 1e-6).count() == 0


def test_forests_read_off_the_largest_equal_the_same_trees_scored_apart(spark, rows):
    """Errors per depth and number of trees, against predictions put together tree by tree by MLlib."""
    table = assemble_features(rows, FEATURES)
    fit = make_estimator("random_forest", "y", {"maxDepth": 4, "maxBins": 16, "numTrees": 5, "seed": 3}).fit(table)
    found = truncated_errors(flat_trees(spark, fit, [1.0]), table, "y", [1, 4], [2, 5])
    y = np.array([r["y"] for r in table.collect()])
    each = np.array([[r["prediction"] for r in t.transform(table).collect()] for t in fit.trees])
    for count in (2, 5):
        assert found[(4, count)] == pytest.approx(np.sqrt(np.mean((each[:count].mean(axis=0) - y) ** 2)))
    same = {"bootstrap": False, "featureSubsetStrategy": "all", "seed": 3}
    shallow = make_estimator("random_forest", "y", {"maxDepth": 1, "maxBins": 16, "numTrees": 2, **same}).fit(table)
    deep = make_estimator("random_forest", "y", {"maxDepth": 4, "maxBins": 16, "numTrees": 5, **same}).fit(table)
    apart = np.array([r["prediction"] for r in shallow.transform(table).collect()])
    assert truncated_errors(flat_trees(spark, deep, [1.0]), table, "y", [1], [2])[(1, 2)] == pytest.approx(np.sqrt(np.mean((apart - y) ** 2)))


def test_a_forest_grid_of_equal_trees_is_the_tree_grid(rows):
    df = kfold(rows, 2, "id")
    same = {"bootstrap": [False], "featureSubsetStrategy": ["all"]}
    forest = cross_validate("random_forest", df, FEATURES, "y", {"maxDepth": [2, 5], "maxBins": [16], "numTrees": [1, 3], **same}, 2, fold_col="fold")
    tree = cross_validate("decision_tree", df, FEATURES, "y", {"maxDepth": [2, 5], "maxBins": [16]}, 2, fold_col="fold", method="rows")
    by_depth = {p["maxDepth"]: e for p, e in zip(tree.points, tree.mean_rmse)}
    assert [e for e in forest.mean_rmse] == pytest.approx([by_depth[p["maxDepth"]] for p in forest.points])


@pytest.mark.parametrize("algorithm", SPECS)
def test_flat_models_predict_as_mllib_does(spark, rows, algorithm):
    params = {"gbt": {"maxIter": 3}, "random_forest": {"numTrees": 4, "seed": 2}}.get(algorithm)
    fitted = fit_model(algorithm, rows, FEATURES, "y", params)
    scored = scoring.predict(fitted, rows).withColumn("which", F.when(F.col("id") % 3 > 0, "y"))
    both = scored.withColumn("flat", predict_by_key(spark, {"y": [fitted, fitted]}, F.col("which"))).collect()
    assert all((r["flat"] is None) == (r["which"] is None) for r in both)
    for r in both:
        if r["flat"] is not None:
            assert r["flat"] == pytest.approx([r["prediction"]] * 2, rel=1e-12)


def test_flat_steps_beyond_between_and_on_the_boundaries():
    steps = FlatSteps(0, np.array([1.0, 2.0, 4.0]), np.array([5.0, 6.0, 10.0]))
    assert steps.apply(np.array([[0.0], [1.0], [1.5], [2.0], [3.0], [4.0], [9.0]])).tolist() == [5, 5, 5.5, 6, 8, 10, 10]
    assert FlatSteps(0, np.array([1.0]), np.array([5.0])).apply(np.array([[0.0], [2.0]])).tolist() == [5, 5]


def test_plain_search_is_the_cross_validator(rows):
    df = kfold(rows, 2, "id")
    grid = {"maxDepth": [1, 3], "maxBins": [16]}
    ours = cross_validate("decision_tree", df, FEATURES, "y", grid, 2, fold_col="fold")
    theirs = cross_validator("decision_tree", "y", grid, 2, fold_col="fold").fit(assemble_features(df, FEATURES))
    assert ours.mean_rmse == pytest.approx(theirs.avgMetrics)
    assert ours.best.params["maxDepth"] == theirs.bestModel.getOrDefault("maxDepth")


def test_tuning_table(spark, rows):
    result = cross_validate("isotonic", rows, FEATURES, "y", key="id")
    table = result.table(spark).collect()
    assert [json.loads(r["params"])["isotonic"] for r in table] == [True, False]
    assert sum(r["best"] for r in table) == 1 and table[0]["best"]


def test_folds_must_be_complete(rows):
    with pytest.raises(ValueError, match="fold"):
        cross_validate("linear", rows.withColumn("fold", F.lit(0)), FEATURES, "y", {"regParam": [0.1]}, 3, fold_col="fold")


def test_comparison_is_sorted_and_right(rows):
    params = {"random_forest": {"numTrees": 2, "seed": 1}, "gbt": {"maxIter": 2}}
    models = fit_all(rows, FEATURES, "y", params)
    table = model_comparison(models, rows).collect()
    assert {r["algorithm"] for r in table} == set(SPECS)
    errors = [r["rmse"] for r in table]
    assert errors == sorted(errors)
    linear = next(m for m in models if m.algorithm == "linear")
    mine = next(r["rmse"] for r in table if r["algorithm"] == "linear")
    assert mine == pytest.approx(linear.metrics["train_rmse"], rel=1e-9)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (4.0, 4.0)], "y double, prediction double")
    row = regression_metrics(df, "y").first()
    assert row["n"] == 3 and row["rmse"] == pytest.approx((1 / 3) ** 0.5)
    assert row["r2"] == pytest.approx(1 - 1 / (14 / 3))


# ---------------------------------------------------------------- registry


@pytest.mark.parametrize("algorithm", list(SPECS))
def test_saved_models_predict_the_same(spark, rows, tmp_path, algorithm):
    registry = ModelRegistry(spark, str(tmp_path))
    params = {"random_forest": {"numTrees": 2, "seed": 1}, "gbt": {"maxIter": 2}}.get(algorithm, {})
    fitted = fit_model(algorithm, rows, FEATURES, "y", params)
    assert registry.load(algorithm, "y") is None
    registry.save(fitted, split_seed=7)
    loaded = registry.load(algorithm, "y")
    assert (loaded.features, loaded.params, loaded.metrics) == (fitted.features, fitted.params, fitted.metrics)
    both = scoring.predict(loaded, scoring.predict(fitted, rows, "p1"), "p2")
    assert both.filter(F.col("p1") != F.col("p2")).count() == 0


def test_train_or_load(spark, rows, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    calls = []

    def train():
        calls.append(1)
        return fit_model("linear", rows, FEATURES, "y")

    first = registry.train_or_load("linear", "y", FEATURES, train)
    again = registry.train_or_load("linear", "y", FEATURES, train)
    assert len(calls) == 1 and np.array_equal(first.model.coefficients, again.model.coefficients)
    registry.train_or_load("linear", "y", FEATURES, train, retrain=True)
    assert len(calls) == 2 and registry.manifests().count() == 2
    with pytest.raises(ValueError, match="features"):
        registry.train_or_load("linear", "y", ["b", "a", "c"], train)


def test_a_model_without_manifest_is_not_found(spark, rows, tmp_path):
    fit_model("linear", rows, FEATURES, "y").model.write().save(str(tmp_path / "linear" / "y" / "v1" / "model"))
    assert ModelRegistry(spark, str(tmp_path)).load("linear", "y") is None


def test_plain_least_squares_agrees_with_numpy(rows):
    table = np.array([list(r) for r in rows.select(*FEATURES, "y").collect()])
    design = np.column_stack([table[:, :3], np.ones(len(table))])
    expected = np.linalg.lstsq(design, table[:, 3], rcond=None)[0]
    model = fit_model("linear", rows, FEATURES, "y").model
    assert np.allclose([*model.coefficients, model.intercept], expected, rtol=1e-6)
    assert isinstance(make_estimator("linear", "y"), LinearRegression)


def test_trees_learn_from_parts_of_bounded_size(spark, monkeypatch):
    """A table in one part is dealt out; each row is kept once, and small tables stay as they are."""
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 50 as double) y")
    seen = []

    class Learner:
        def fit(self, rows):
            seen.append([len(part) for part in rows.rdd.glom().collect()])
            assert sorted(r["y"] for r in rows.collect()) == sorted(r["y"] for r in df.collect())

    monkeypatch.setattr("gapcast.operators.models.make_estimator", lambda *a: Learner())
    fit_model("gbt", df, ["a"], "y")
    monkeypatch.setattr("gapcast.operators.models.ROWS_PER_TASK", 100)
    fit_model("gbt", df, ["a"], "y")
    assert seen[0] == [1000] and len(seen[1]) == 10 and max(seen[1]) <= 101
