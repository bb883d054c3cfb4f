import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.operators import quality
from gapcast.operators.features import assemble_features, feature_columns
from gapcast.plans.imputation import route_messages
from gapcast.sources.messages import decode_message, typed_fields

SCHEMA = T.StructType(
    [T.StructField("timestamp", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())]
)


def detect(spark, text, **kwargs):
    df = decode_message(spark.createDataFrame([(text,)], "value string"))
    return quality.detect_missing(df, **kwargs).first()


def route(spark, text, **kwargs):
    return route_messages(spark.createDataFrame([(text,)], "value string"), SCHEMA, **kwargs).first()


@pytest.mark.parametrize("value", ["null", '""', '"undefined"'])
def test_missing_values(spark, value):
    row = detect(spark, f'{{"b": 1, "a": {value}}}')
    assert row["label"] == "a" and row["missing"] == ["a"]


@pytest.mark.parametrize("value", ["0", "false", '" "', '"null"', '"Undefined"', "NaN", "{}", "[null]"])
def test_values_that_are_there(spark, value):
    row = detect(spark, f'{{"a": {value}}}')
    assert row["label"] is None and row["missing"] == []


def test_first_missing_in_payload_order(spark):
    row = detect(spark, '{"z": 1, "m": "", "b": null, "a": "undefined"}')
    assert row["label"] == "m" and row["missing"] == ["m", "b", "a"]


def test_nested_objects_are_not_searched(spark):
    assert detect(spark, '{"a": {"x": null}}')["label"] is None


def test_absent_keys_count_only_when_expected(spark):
    assert detect(spark, '{"a": 1}')["label"] is None
    row = detect(spark, '{"a": 1, "c": null}', expected_fields=["a", "b"])
    assert row["missing"] == ["c", "b"]


def test_a_repeated_key_counts_with_its_last_value(spark):
    assert detect(spark, '{"a": 1, "a": null}')["label"] == "a"
    assert detect(spark, '{"a": null, "b": "", "a": 1}')["missing"] == ["b"]


@pytest.mark.parametrize("text", ["broken", "[1, 2]", '{"a": 1', "", "null", "7"])
def test_messages_that_are_no_object(spark, text):
    row = route(spark, text)
    assert row["payload"] is None and row["route"] == "reject" and row["reason"] == "bad_json"


def test_bytes_that_are_not_utf8(spark):
    df = spark.createDataFrame([(bytearray(b'{"a": "\xff"}'),), (bytearray('{"a": "é"}'.encode()),)], "value binary")
    assert [r["payload"] for r in decode_message(df).collect()] == [None, {"a": "é"}]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"timestamp": 5, "a": 1, "b": 2}', ("complete", None)),
        ('{"timestamp": 5, "a": null, "b": 2}', ("impute", None)),
        ('{"timestamp": 5, "a": null, "b": ""}', ("reject", "several_missing")),
        ('{"timestamp": null, "a": 1, "b": 2}', ("reject", "timestamp_missing")),
        ('{"timestamp": 5, "a": 1, "b": 2, "c": null}', ("reject", "unknown_field")),
        ('{"timestamp": 5, "a": null, "b": "high"}', ("reject", "not_numeric")),
        ('{"timestamp": 5, "a": null}', ("reject", "absent_field")),
        ('{"timestamp": 5, "a": 1}', ("complete", None)),
        ('{"timestamp": 5, "a": null, "b": NaN}', ("reject", "not_numeric")),
    ],
)
def test_routes(spark, text, expected):
    row = route(spark, text)
    assert (row["route"], row["reason"]) == expected


def test_first_of_several(spark):
    row = route(spark, '{"timestamp": 5, "b": "", "a": null}', several_missing="first")
    assert (row["route"], row["label"]) == ("impute", "b")


def test_every_message_has_one_route(spark):
    texts = ["x", "{}", '{"timestamp": 1, "a": null, "b": 1}', '{"timestamp": 1, "a": 1, "b": 1}', None]
    df = route_messages(spark.createDataFrame([(t,) for t in texts], "value string"), SCHEMA)
    assert df.filter(F.col("route").isNull()).count() == 0 and df.count() == len(texts)
    assert quality.collect_bad_input(df).count() == 2


def test_filters_do_not_repeat_the_parse(spark):
    df = route_messages(spark.createDataFrame([("{}",)], "value string"), SCHEMA)
    plan = df.filter("route = 'impute' AND label = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_typed_fields(spark):
    df = decode_message(spark.createDataFrame([('{"timestamp": 5, "a": "undefined", "b": 2}',)], "value string"))
    row = typed_fields(df, SCHEMA).first()
    assert (row["timestamp"], row["a"], row["b"]) == (5, None, 2.0)


def test_label_cast_and_fill(spark):
    df = spark.createDataFrame([("1.5", None), ("undefined", None), ("", 2.0), (None, 1.0)], "a string, b double")
    filled = quality.fill_label(quality.cast_label_double(df, "a"), "a")
    assert [tuple(r) for r in filled.collect()] == [(1.5, None), (0.0, None), (0.0, 2.0), (0.0, 1.0)]


def test_labelled_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "a double")
    assert quality.labelled(df, "a").count() == 1


def test_assembler_errors(spark):
    df = spark.createDataFrame([(1.0, "x", None)], "a double, s string, n double")
    assert feature_columns(df, "a") == ["s", "n"]
    with pytest.raises(IllegalArgumentException):
        assemble_features(df, ["s"])
    with pytest.raises(Exception, match="(?i)null"):
        assemble_features(df, ["n"]).collect()
    assert assemble_features(df, ["n"], handle_invalid="skip").count() == 0
