import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gapcast.sources.topic import DataLoss, TopicLog, _TopicReading, append_to_topic, create_topic, read_stream_topic, read_topic


def messages(spark, first, end):
    rows = [(f"k{i % 7}", json.dumps({"n": i}), i) for i in range(first, end)]
    return spark.createDataFrame(rows, "key string, value string, s long").withColumn("at", F.timestamp_seconds("s"))


def append(spark, path, first, end):
    append_to_topic(messages(spark, first, end), path, key="key", timestamp="at")


def numbers(df):
    return sorted(json.loads(r["value"])["n"] for r in df.select(F.col("value").cast("string")).collect())


@pytest.fixture
def topic(spark, tmp_path):
    path = str(tmp_path / "readings")
    create_topic(spark, path, 3)
    return path


def start(stream, tmp_path, **trigger):
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    return out.trigger(**trigger).start() if trigger else out.start()


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_offsets_are_dense_and_ordered_per_partition(spark, topic):
    for first, end in ((0, 40), (40, 41), (41, 41), (41, 200)):
        append(spark, topic, first, end)
    rows = read_topic(spark, topic).collect()
    assert {r["topic"] for r in rows} == {"readings"} and len({r["key"] for r in rows}) == 7
    for p in range(3):
        own = sorted((r["offset"], json.loads(r["value"])["n"], r["timestamp"]) for r in rows if r["partition"] == p)
        assert [o for o, _, _ in own] == list(range(len(own)))
        assert [n for _, n, _ in own] == sorted(n for _, n, _ in own) and [t for _, _, t in own] == sorted(t for _, _, t in own)
    assert sorted(json.loads(r["value"])["n"] for r in rows) == list(range(200))


def test_a_table_between_offsets(spark, topic):
    append(spark, topic, 0, 100)
    bounds = TopicLog(topic).bounds()
    some = {str(p): min(5, end) for p, (_, end) in bounds.items()}
    head = read_topic(spark, topic, endingOffsets=json.dumps(some))
    tail = read_topic(spark, topic, startingOffsets=json.dumps(some), rowsPerTask=4)
    assert head.count() == sum(some.values()) and numbers(head.union(tail)) == list(range(100))
    with pytest.raises(Exception, match="must name the partitions"):
        read_topic(spark, topic, startingOffsets='{"0": 1}').count()
    create_topic(spark, topic + "2", 2)
    assert read_topic(spark, topic + "2").count() == 0


def test_latest_then_stop_then_resume_loses_nothing(spark, topic, tmp_path):
    append(spark, topic, 0, 30)
    stream = read_stream_topic(spark, topic)
    query = start(stream, tmp_path)
    query.processAllAvailable()
    append(spark, topic, 30, 60)
    query.processAllAvailable()
    query.stop()
    append(spark, topic, 60, 90)  # while stopped
    finish(start(read_stream_topic(spark, topic), tmp_path, availableNow=True))
    assert numbers(spark.read.parquet(str(tmp_path / "out"))) == list(range(30, 90))


def test_a_first_start_without_messages_remembers_latest(spark, topic, tmp_path):
    append(spark, topic, 0, 10)
    finish(start(read_stream_topic(spark, topic), tmp_path, availableNow=True))
    append(spark, topic, 10, 25)
    finish(start(read_stream_topic(spark, topic), tmp_path, availableNow=True))
    assert numbers(spark.read.parquet(str(tmp_path / "out"))) == list(range(10, 25))


def test_earliest_and_given_offsets(spark, topic, tmp_path):
    append(spark, topic, 0, 50)
    finish(start(read_stream_topic(spark, topic, "earliest"), tmp_path, availableNow=True))
    assert numbers(spark.read.parquet(str(tmp_path / "out"))) == list(range(50))
    given = json.dumps({"0": -2, "1": -1, "2": 3})
    (tmp_path / "b").mkdir()
    finish(start(read_stream_topic(spark, topic, given), tmp_path / "b", availableNow=True))
    expected = read_topic(spark, topic).where("partition = 0 OR (partition = 2 AND offset >= 3)")
    assert numbers(spark.read.parquet(str(tmp_path / "b" / "out"))) == numbers(expected)


def test_a_limit_per_trigger_gives_small_batches(spark, topic, tmp_path):
    append(spark, topic, 0, 1)
    query = start(read_stream_topic(spark, topic, "earliest", max_offsets_per_trigger=9), tmp_path)
    query.processAllAvailable()
    append(spark, topic, 1, 100)
    query.processAllAvailable()
    sizes = [p["numInputRows"] for p in query.recentProgress]
    query.stop()
    assert max(sizes) <= 9 and numbers(spark.read.parquet(str(tmp_path / "out"))) == list(range(100))


def test_messages_that_are_gone_are_not_passed_over(spark, topic, tmp_path):
    append(spark, topic, 0, 10)
    finish(start(read_stream_topic(spark, topic, "earliest"), tmp_path, availableNow=True))
    append(spark, topic, 10, 50)
    append(spark, topic, 50, 90)
    log = TopicLog(topic)
    for own in log.segments().values():  # retention took the middle segment of every partition
        for segment in own[:2]:
            os.remove(segment.path)
    query = start(read_stream_topic(spark, topic), tmp_path, availableNow=True)
    with pytest.raises(Exception, match="gone"):
        query.awaitTermination()
    finish(start(read_stream_topic(spark, topic, fail_on_data_loss=False), tmp_path, availableNow=True))
    assert numbers(spark.read.parquet(str(tmp_path / "out"))) == [*range(10), *range(50, 90)]


def test_a_gap_in_the_log_is_not_read_past(spark, topic):
    for first, end in ((0, 30), (30, 60), (60, 90)):
        append(spark, topic, first, end)
    log = TopicLog(topic)
    middle = log.segments()[0][1]
    os.rename(middle.path, middle.path + ".late")
    assert TopicLog(topic).bounds()[0] == (0, middle.first)
    with pytest.raises(DataLoss):
        list(TopicLog(topic).read(0, 0, middle.end))


def test_an_append_is_cut_into_segments_and_a_task_reads_only_its_own(spark, topic, monkeypatch):
    monkeypatch.setattr("gapcast.sources.topic.ROWS_PER_TASK", 10)
    append(spark, topic, 0, 100)
    log = TopicLog(topic)
    assert all(s.end - s.first <= 10 for own in log.segments().values() for s in own)
    ranges = _TopicReading({"path": topic}).ranges({}, {str(p): end for p, (_, end) in log.bounds().items()})
    assert sum(r.end - r.first for r in ranges) == 100 and all(len(r.segments) == 1 for r in ranges)
    monkeypatch.setattr(TopicLog, "segments", lambda self: pytest.fail("a task lists the topic"))
    found = [n for r in ranges for batch in log.read(r.partition, r.first, r.end, r.segments) for n in batch.column("value").to_pylist()]
    assert sorted(json.loads(v)["n"] for v in found) == list(range(100))


def test_a_range_reads_the_row_groups_it_needs(tmp_path):
    path = str(tmp_path / "s.parquet")
    pq.write_table(pa.table({"offset": pa.array(range(100), pa.int64())}), path, row_group_size=10)
    assert TopicLog._groups(pq.ParquetFile(path).metadata, 15, 31) == [1, 2, 3]
