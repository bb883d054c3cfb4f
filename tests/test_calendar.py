from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gapcast.functions import calendar as cal

EPOCHS = [1687785784541, 1678134763546, -1500, 0, 999, -999]


@pytest.fixture(scope="module")
def epochs(spark):
    return spark.createDataFrame([(e,) for e in EPOCHS] + [(None,)], "timestamp long")


def test_known_readings(epochs):
    rows = cal.calendar_features(epochs).collect()
    assert tuple(rows[0]) == (6, 26, 4)
    assert tuple(rows[1]) == (3, 6, 6)
    assert tuple(rows[2]) == (12, 31, 7)
    assert tuple(rows[3]) == (1, 1, 0)
    assert tuple(rows[6]) == (None, None, None)


def test_truncation_is_toward_zero(epochs):
    seconds = [r[0] for r in epochs.select(cal.ms_to_seconds(F.col("timestamp"))).collect()]
    assert seconds == [1687785784, 1678134763, -1, 0, 0, 0, None]


def test_types_and_position(epochs):
    df = epochs.select("timestamp", F.lit(1.0).alias("rain"))
    assert cal.calendar_features(df).dtypes == [
        ("rain", "double"),
        ("month", "int"),
        ("day", "int"),
        ("hour_range", "bigint"),
    ]
    assert dict(cal.calendar_features(df, as_int=True).dtypes)["hour_range"] == "int"


def test_session_zone_does_not_matter(spark, epochs):
    expected = cal.calendar_features(epochs, tz="Europe/Rome").collect()
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert cal.calendar_features(epochs, tz="Europe/Rome").collect() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_zone_moves_the_day(spark):
    df = spark.createDataFrame([(1678134763546,)], "timestamp long")
    assert tuple(cal.calendar_features(df, tz="Asia/Tokyo").first()) == (3, 7, 1)


def test_format_and_parse(spark):
    df = spark.createDataFrame([(1678134763,)], "s long")
    text = cal.format_epoch(F.col("s"))
    row = df.select(text.alias("t"), cal.parse_timestamp(text).alias("p"), cal.parse_timestamp(F.lit("x")).alias("q")).first()
    assert row["t"] == "2023-03-06 20:32:43"
    assert row["p"] == datetime(2023, 3, 6, 20, 32, 43) and row["q"] is None


def test_hour_ranges(spark):
    hours = spark.range(24).select(cal.hour_range(F.col("id").cast("int")).alias("r")).collect()
    assert [r["r"] for r in hours] == [h // 3 for h in range(24)]


def test_epoch_millis_inverts(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2023-03-06 20:32:43.546789' AS t")
    assert df.select(cal.epoch_millis(F.col("t"))).first()[0] == 1678134763546


def test_features_work_on_a_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"timestamp": 1678134763546, "rain": 1.0}')
    stream = spark.readStream.schema("timestamp long, rain double").json(str(tmp_path))
    query = cal.calendar_features(stream).writeStream.format("memory").queryName("cal").start()
    query.processAllAvailable()
    query.stop()
    assert tuple(spark.table("cal").first()) == (1.0, 3, 6, 6)
