import pytest

from gapcast.operators.metrics import regression_metrics
from gapcast.operators.models import fit_model
from gapcast.operators.scoring import model_names, predict_missing, score_test
from gapcast.operators.tuning import model_comparison


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(50)], "x double, y double")


def test_two_models_of_one_algorithm(line):
    models = [fit_model("linear", line, ["x"], "y", {"regParam": r}) for r in (0.0, 100.0)]
    rows = model_comparison(models, line).collect()
    assert [r["algorithm"] for r in rows] == ["linear"] * 2
    assert rows[0]["rmse"] == pytest.approx(0, abs=1e-6) and rows[1]["rmse"] > 1
    assert score_test(models, line) == [r["rmse"] for r in rows]
    assert model_names(models) == ["linear", "linear_2"]


def test_only_gaps_are_scored(spark, line):
    fitted = fit_model("linear", line, ["x"], "y")
    df = spark.createDataFrame(
        [(1, 1.0, 9.0), (2, 2.0, None), (3, None, 7.0), (4, None, None), (5, float("nan"), None)], "id int, x double, y double"
    )
    found = {r["id"]: r for r in predict_missing(fitted, df).collect()}
    assert found[2]["imputed"] and found[2]["y"] == pytest.approx(5.0)
    assert [found[i]["y"] for i in (1, 3, 4, 5)] == [9.0, 7.0, None, None]
    assert not any(found[i]["imputed"] for i in (1, 3, 4, 5)) and found[3]["x"] is None
    assert all(found[i]["prediction"] is None for i in (1, 3, 4, 5))


def test_r2_of_a_constant_label_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (5.0, None), (None, 3.0)], "y double, prediction double")
    row = regression_metrics(df, "y").first()
    assert row["n"] == 2 and row["r2"] is None and row["rmse"] == pytest.approx(0.5**0.5)
