import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.schema import SENSOR_FIELDS, numeric_columns, reading_schema, text_columns
from gapcast.scratch import ensure_checkpoint_dir, shared_dir
from gapcast.sources import readings as src
from gapcast.sources import sinks
from gapcast.sources.kafka import kafka_options, read_stream_kafka

# A pretty-printed reading with a gap.
PRETTY = """{
  "timestamp": 1700000000123,
  "temperature": null,
  "humidity": 40.5,
  "pressure": 101.25,
  "light": 0,
  "wind_speed": 3.75,
  "wind_force": 1,
  "wind_dir_degrees": 45,
  "wind_dir": 1,
  "rain": 0.25,
  "pm2_5": 1.5,
  "pm10": 2.5
}"""


def test_reading_schema():
    schema = reading_schema()
    assert schema.names == ["timestamp", *SENSOR_FIELDS]
    assert isinstance(schema["timestamp"].dataType, T.LongType)
    assert {type(schema[f].dataType) for f in SENSOR_FIELDS} == {T.DoubleType}


def test_json_line_and_multiline_agree(spark, tmp_path):
    (tmp_path / "pretty.json").write_text(PRETTY)
    (tmp_path / "line.json").write_text(json.dumps(json.loads(PRETTY)))
    pretty = src.read_reading_json(spark, str(tmp_path / "pretty.json"), multiline=True)
    line = src.read_reading_json(spark, str(tmp_path / "line.json"))
    assert pretty.collect() == line.collect()
    row = line.first()
    assert row["temperature"] is None and row["light"] == 0.0 and row["timestamp"] == 1700000000123


def test_raw_messages_of_a_pretty_file(spark, tmp_path):
    (tmp_path / "pretty.json").write_text(PRETTY)
    assert src.read_messages(spark, str(tmp_path / "pretty.json"), multiline=True).count() == 1


def test_csv_types_follow_the_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("rain,timestamp,site\n0.5,1000,a\n,2000,b\n")
    df = src.read_history_csv(spark, str(tmp_path / "h.csv"))
    assert df.dtypes == [("rain", "double"), ("timestamp", "bigint"), ("site", "string")]
    assert [tuple(r) for r in df.orderBy("timestamp").collect()] == [(0.5, 1000, "a"), (None, 2000, "b")]


def test_csv_inference_is_an_option(spark, tmp_path):
    (tmp_path / "h.csv").write_text("rain,timestamp\n1,1000\n")
    df = src.read_history_csv(spark, str(tmp_path / "h.csv"), infer=True)
    assert df.dtypes == [("rain", "int"), ("timestamp", "int")]


def test_csv_files_with_different_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rain,timestamp\n1,1000\n")
    (tmp_path / "b.csv").write_text("timestamp,rain\n1000,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        src.read_history_csv(spark, str(tmp_path)).collect()


def test_json_sink_keeps_the_gap(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "timestamp long, rain double")
    sinks.write_reading_json(df, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).first()["value"]
    assert json.loads(text) == {"timestamp": 1, "rain": None}


def test_history_partitioning(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "month int, rain double")
    sinks.write_history(df, str(tmp_path / "h"), partition_by=["month"])
    pruned = src.read_history_parquet(spark, str(tmp_path / "h")).filter("month = 2")
    assert [r["rain"] for r in pruned.collect()] == [3.0]


def test_preview_is_ordered(spark):
    df = spark.range(100)
    assert [r["id"] for r in sinks.preview(df, [F.desc("id")], 3).collect()] == [99, 98, 97]


def test_kafka_options():
    options = kafka_options("host:9092", "readings", max_offsets_per_trigger=1000, extra={"failOnDataLoss": "true"})
    assert options == {
        "kafka.bootstrap.servers": "host:9092",
        "subscribe": "readings",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "1000",
        "failOnDataLoss": "true",
    }


def test_kafka_needs_its_connector(spark):
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        read_stream_kafka(spark, "host:9092", "readings")


def test_numeric_columns(spark):
    df = spark.createDataFrame([], "a double, b int, c long, d string, e boolean")
    assert numeric_columns(df) == ["a", "b", "c"]
    assert numeric_columns(df, strict_types=True) == ["a", "b"]
    assert text_columns(df) == ["d", "e"]


def test_shared_dir_is_new_each_time(spark):
    ensure_checkpoint_dir(spark)
    assert shared_dir(spark) != shared_dir(spark)


def test_lines_that_do_not_convert_are_kept_apart(spark, tmp_path):
    (tmp_path / "h.csv").write_text("rain,timestamp\n0.5,1000\nwet,2000\n,3000\n")
    good, bad = src.split_corrupt(src.read_history_csv(spark, str(tmp_path / "h.csv"), corrupt="bad"), "bad")
    assert sorted(r["timestamp"] for r in good.collect()) == [1000, 3000]
    assert [tuple(r) for r in bad.collect()] == [("wet,2000", "bad_record")]
    (tmp_path / "r.json").write_text('{"timestamp": 1, "rain": 2.0}\n{"timestamp": 2, "rain"\n')
    good, bad = src.split_corrupt(src.read_reading_json(spark, str(tmp_path / "r.json"), corrupt="bad"), "bad")
    assert good.count() == 1 and bad.first()["value"].startswith('{"timestamp": 2')


def test_raw_messages_keep_their_bytes(spark, tmp_path):
    raw = [PRETTY.encode(), b"\xff\xfe not text", b""]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "value binary")
    sinks.write_raw_messages(df, str(tmp_path / "raw"))
    assert sorted(bytes(r["value"]) for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == sorted(raw)
