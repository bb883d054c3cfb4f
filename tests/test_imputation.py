import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.functions.calendar import calendar_columns
from gapcast.operators import scoring
from gapcast.operators.models import fit_model
from gapcast.operators.registry import ModelRegistry
from gapcast.operators.scoring import predict_missing
from gapcast.plans.correlation import correlation_report
from gapcast.plans.imputation import (
    complete_readings,
    impute_messages,
    route_messages,
    score_by_label,
    stage_by_label,
)
from gapcast.plans.regression import analyse_gap, run_regression
from gapcast.schema import SENSOR_FIELDS, reading_schema
from gapcast.sources.kafka import read_stream_raw, read_stream_text
from gapcast.sources.sinks import write_raw_messages
from gapcast.streaming.impute import stream_impute

FIELDS = ["timestamp", *SENSOR_FIELDS]


def make_readings(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r = {f: round(rng.uniform(0, 10), 3) for f in SENSOR_FIELDS}
        r["temperature"] = round(2 * r["humidity"] - r["pressure"] + rng.gauss(0, 0.01), 4)
        out.append({"timestamp": 1700000000123 + i * 3_600_000, **r})
    return out


@pytest.fixture(scope="module")
def readings():
    return make_readings(400)


@pytest.fixture(scope="module")
def history(spark, readings):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in readings], reading_schema()).persist()


@pytest.fixture(scope="module")
def messages(readings):
    """Every third message lacks temperature, every fifth rain, some are broken."""
    out = []
    for i, r in enumerate(readings):
        m = dict(r)
        if i % 3 == 0:
            m["temperature"] = [None, "", "undefined"][i % 9 // 3]
        elif i % 5 == 0:
            m["rain"] = None
        if i % 50 == 7:
            out.append("{broken")
        else:
            out.append(json.dumps(m))
    return out


@pytest.fixture(scope="module")
def models(history):
    from gapcast.functions.calendar import calendar_features
    from gapcast.operators.features import feature_columns

    table = calendar_features(history)
    out = {}
    for label in ("temperature", "rain"):
        features = feature_columns(table, label)
        out[label] = [
            fit_model("linear", table, features, label),
            fit_model("decision_tree", table, features, label, {"maxDepth": 4}),
        ]
    return out


def as_messages(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def bag(df):
    cols = sorted(c for c in df.columns if c not in ("value", "batch_id", "predictions"))
    return sorted(map(repr, df.select(*cols).collect()))


def test_thirteen_features(models):
    assert len(models["temperature"][0].features) == 13
    assert models["temperature"][0].features[-3:] == ["month", "day", "hour_range"]


def test_gaps_are_filled(spark, messages, readings, models):
    filled, rejects = impute_messages(as_messages(spark, messages), models)
    rows = {r["timestamp"]: r for r in filled.collect()}
    assert len(rows) + rejects.count() == len(messages)
    assert rejects.select("reason").distinct().collect()[0][0] == "bad_json"
    for i, r in enumerate(readings):
        row = rows.get(r["timestamp"])
        if row is None:
            continue
        if i % 3 == 0:
            assert row["label"] == "temperature" and row["imputed"]
            assert row["temperature"] == pytest.approx(r["temperature"], abs=0.2)
            assert set(row["predictions"]) == {"linear", "decision_tree"}
            assert row["prediction"] == row["predictions"]["linear"] == row["temperature"]
        elif i % 5 == 0:
            assert row["label"] == "rain" and row["rain"] is not None
        else:
            assert not row["imputed"] and row["prediction"] is None
            assert {f: row[f] for f in FIELDS} == r


def test_staged_scoring_is_the_same(spark, messages, models, tmp_path):
    direct = impute_messages(as_messages(spark, messages), models, staging_dir=None)
    staged = impute_messages(as_messages(spark, messages), models, staging_dir=str(tmp_path / "staged"))
    assert direct[0].columns == staged[0].columns and direct[1].columns == staged[1].columns
    assert bag(direct[0]) == bag(staged[0])
    assert bag(direct[1].drop("payload")) == bag(staged[1].drop("payload"))


def test_scoring_reads_the_staged_table_once(spark, messages, models, tmp_path):
    staged = stage_by_label(route_messages(as_messages(spark, messages)), str(tmp_path))
    filled, _ = score_by_label(staged, models)
    scans = [line for line in filled._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert len(scans) == 1
    assert complete_readings(staged).count() == filled.filter("NOT imputed").count()


def test_labels_without_model_are_rejected(spark, models):
    reading = {f: 1.0 for f in SENSOR_FIELDS}
    texts = [json.dumps({"timestamp": 1, **reading, "light": None}), json.dumps({"timestamp": 1, **reading, "rain": None})]
    filled, rejects = impute_messages(as_messages(spark, texts), models)
    assert filled.count() == 1 and [r["reason"] for r in rejects.collect()] == ["no_model"]


def test_first_of_several_needs_its_features(spark, models):
    reading = {f: 1.0 for f in SENSOR_FIELDS}
    text = json.dumps({"timestamp": 1, **reading, "rain": None, "light": ""})
    _, rejects = impute_messages(as_messages(spark, [text]), models, several_missing="first")
    assert [r["reason"] for r in rejects.collect()] == ["feature_missing" if text.index("rain") < text.index("light") else "no_model"]


def test_no_models_at_all(spark, messages):
    filled, rejects = impute_messages(as_messages(spark, messages), {})
    assert filled.count() + rejects.count() == len(messages)
    assert filled.filter("imputed").count() == 0


def test_predict_missing_marks_rows(spark, history, models):
    from gapcast.functions.calendar import calendar_features

    fitted = models["temperature"][0]
    table = calendar_features(history).withColumn("temperature", F.when(F.col("rain") < 5, F.col("temperature")))
    out = predict_missing(fitted, table)
    assert out.filter(F.col("temperature").isNull()).count() == 0
    assert out.filter("imputed").count() == table.filter("temperature IS NULL").count()
    assert out.filter("NOT imputed").exceptAll(out.filter("NOT imputed AND rain < 5")).count() == 0


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, messages, models, tmp_path, files):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    for fitted in models.values():
        for m in fitted:
            registry.save(m)
    as_messages(spark, messages).repartition(files).write.text(str(tmp_path / "in"))
    query = stream_impute(
        read_stream_text(spark, str(tmp_path / "in"), max_files_per_trigger=1),
        registry,
        ["linear", "decision_tree"],
        str(tmp_path / "out"),
        str(tmp_path / "checkpoint"),
        rejects_dir=str(tmp_path / "rejects"),
        raw_dir=str(tmp_path / "raw"),
    )
    query.awaitTermination()
    filled, rejects = impute_messages(as_messages(spark, messages), models)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.select("batch_id").distinct().count() == files
    assert bag(streamed) == bag(filled)
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == rejects.count()
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert sorted(bytes(r["value"]).decode() for r in raw.collect()) == sorted(messages)


def test_stream_goes_on_from_its_checkpoint(spark, messages, models, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    registry.save(models["temperature"][0])
    for part in (messages[:100], messages[100:150]):
        as_messages(spark, part).coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        stream_impute(
            read_stream_text(spark, str(tmp_path / "in")),
            registry,
            "linear",
            str(tmp_path / "out"),
            str(tmp_path / "checkpoint"),
            rejects_dir=str(tmp_path / "rejects"),
        ).awaitTermination()
    total = spark.read.parquet(str(tmp_path / "out")).count() + spark.read.parquet(str(tmp_path / "rejects")).count()
    assert total == 150


@pytest.fixture
def poison():
    """A good gap, a gap beside a text that is no finite number, and a complete reading with such a text."""
    reading = {k: 5.0 for k in SENSOR_FIELDS} | {"timestamp": 1700000000123}
    return [
        json.dumps(reading | {"temperature": None}),
        json.dumps(reading | {"temperature": None, "rain": "NaN"}),
        json.dumps(reading | {"rain": "Infinity"}),
    ]


def test_texts_that_are_no_number_are_rejected(spark, models, poison):
    filled, rejects = impute_messages(as_messages(spark, poison), models)
    assert filled.filter("imputed").count() == filled.count() == 1
    assert [r["reason"] for r in rejects.collect()] == ["not_numeric"] * 2


def test_the_stream_rejects_them_too(spark, models, poison, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    registry.save(models["temperature"][0])
    write_raw_messages(as_messages(spark, [*poison, "{broken"]), str(tmp_path / "in"))
    stream_impute(
        read_stream_raw(spark, str(tmp_path / "in")),
        registry,
        "linear",
        *(str(tmp_path / part) for part in ("out", "checkpoint", "rejects")),
    ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    reasons = sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect())
    assert reasons == ["bad_json", "not_numeric", "not_numeric"]


def test_a_stream_without_models_is_refused(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    folders = [str(tmp_path / part) for part in ("out", "checkpoint", "rejects")]
    for algorithm in ("linear", "lineer"):
        with pytest.raises(ValueError):
            stream_impute(read_stream_raw(spark, str(tmp_path)), registry, algorithm, *folders)


def test_a_model_of_another_split_is_refused(spark, history, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    args, grid = (history, "temperature", "linear", registry), {"regParam": [0.001]}
    run_regression(*args, grid=grid, seed=1)
    for other in ({"seed": 2}, {"seed": 1, "tz": "Asia/Tokyo"}, {"seed": 1, "train": 0.6}):
        with pytest.raises(ValueError, match="was trained with"):
            run_regression(*args, grid=grid, **other)
    assert run_regression(*args, grid=grid, seed=2, retrain=True).rmse < 0.2
    assert registry.manifests().count() == 2


def test_run_regression(spark, history, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    new = spark.createDataFrame(
        [(1687785784541, *[None if f == "temperature" else 5.0 for f in SENSOR_FIELDS])], reading_schema()
    )
    args = (history, "temperature", "linear", registry, new)
    grid = {"regParam": [0.001, 1.0], "elasticNetParam": [0.5]}
    first = run_regression(*args, grid=grid)
    again = run_regression(*args, grid=grid)
    assert first.fitted.params == {"regParam": 0.001, "elasticNetParam": 0.5}
    assert first.rmse == pytest.approx(again.rmse) and first.rmse < 0.2
    assert first.test_predictions.columns == ["prediction", "temperature", "features"]
    row = first.new_predictions.first()
    assert row["imputed"] and row["temperature"] == pytest.approx(5.0, abs=0.2)
    assert registry.manifests().count() == 1
    with pytest.raises(ValueError):
        run_regression(history, "timestamp", "linear", registry)


def test_text_labels_are_cast(spark, history, tmp_path):
    texts = history.withColumn(
        "temperature", F.when(F.col("rain") < 1, "undefined").otherwise(F.col("temperature").cast("string"))
    )
    run = run_regression(texts, "temperature", "linear", ModelRegistry(spark, str(tmp_path)), grid={"regParam": [0.001]})
    assert run.rmse < 0.2


def test_gap_analysis(spark, history, tmp_path):
    grids = {
        "linear": {"regParam": [0.001]},
        "decision_tree": {"maxDepth": [3], "maxBins": [20]},
        "gbt": {"maxDepth": [2], "maxBins": [20], "maxIter": [2]},
        "random_forest": {"maxDepth": [3], "maxBins": [40], "numTrees": [2]},
    }
    report = analyse_gap(history, "temperature", ModelRegistry(spark, str(tmp_path)), grids=grids)
    assert report.comparison.first()["algorithm"] == "linear"
    assert set(report.runs) == {"linear", "isotonic", "decision_tree", "gbt", "random_forest"}
    assert all(r.rmse > 0 for r in report.runs.values())
    assert report.runs["gbt"].importance.count() == 13
    assert report.runs["isotonic"].steps.count() > 0 and report.runs["decision_tree"].rules.count() > 3
    assert report.profile.count() == 14
    assert report.correlation.correlations.count() == 14


def test_correlation_report(spark, history):
    report = correlation_report(history, "temperature", fraction=0.8, seed=1)
    assert report.correlations.filter("column = 'temperature'").first()["corr"] == pytest.approx(1.0)
    assert report.pairs.select("x", "y").distinct().count() == 14 * 13 // 2
    assert report.histograms.count() == 14 * 10
    assert 0 < report.histograms.filter("column = 'rain'").agg(F.sum("n")).first()[0] < 400


def test_routing_keeps_every_message(spark, messages):
    routed = route_messages(as_messages(spark, messages))
    assert routed.count() == len(messages)
    assert isinstance(routed.schema["timestamp"].dataType, T.LongType)


def test_all_labels_are_scored_in_one_scan(spark, messages, models):
    """Whatever the number of labels the plan has one scan and one function, and MLlib's predictions come out."""
    routed = route_messages(as_messages(spark, messages))
    filled, _ = score_by_label(routed, models)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan") == 1 and "Union" not in plan
    for label, fitted in models.items():
        part = routed.where((F.col("route") == "impute") & (F.col("label") == label)).withColumns(calendar_columns(F.col("timestamp"), "UTC"))
        for model in fitted:
            part = scoring.predict(model, part, f"p_{model.algorithm}")
        expected = {r["timestamp"]: r for r in part.collect()}
        got = filled.where((F.col("label") == label) & F.col("imputed")).collect()
        assert len(got) > 0
        for r in got:
            for name, value in r["predictions"].items():
                assert value == pytest.approx(expected[r["timestamp"]][f"p_{name}"], rel=1e-9)
            assert r[label] == r["prediction"] == r["predictions"][fitted[0].algorithm]
