"""A topic kept in a folder: a partitioned log with offsets, read as a stream or a table.

Each partition of the topic is a folder of Parquet segments; a message has its
offset in its partition, counted from 0. The stream source has the meaning of
Kafka's: rows with key, value, topic, partition, offset and timestamp; where to
start (earliest, latest or given offsets) counts on the first start only, and
afterwards the query's checkpoint says where to go on. It replays a log, or
stands in for a broker where there is none.
"""

from __future__ import annotations

import json
import posixpath
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
FORMAT = "topic_folder"
# Messages in one task at most, unless an option says otherwise; also in one segment.
ROWS_PER_TASK = 100_000


class DataLoss(RuntimeError):
    """Messages that a query still has to read are gone."""


@dataclass(frozen=True)
class Segment:
    """A file of a partition with the offsets [first, end)."""

    partition: int
    first: int
    end: int
    path: str


@dataclass
class OffsetRange(InputPartition):
    """The messages of a partition with offsets [first, end), and the segments they lie in."""

    partition: int
    first: int
    end: int
    segments: tuple[Segment, ...] = ()


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class TopicLog:
    """The segments of a topic. Offsets come from file footers; a footer is read once."""

    def __init__(self, path: str):
        self.path = path
        self._known: dict[str, Segment | None] = {}

    def partition_count(self) -> int:
        fs, root = _file_system(self.path)
        with fs.open_input_stream(posixpath.join(root, "_topic.json")) as f:
            return json.loads(f.read())["partitions"]

    def segments(self) -> dict[int, list[Segment]]:
        """Segments of every partition in order of their offsets."""
        fs, root = _file_system(self.path)
        found: dict[int, list[Segment]] = {p: [] for p in range(self.partition_count())}
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != pafs.FileType.File or not info.base_name.endswith(".parquet") or "/_" in info.path[len(root) :]:
                continue
            if info.path not in self._known:
                self._known[info.path] = self._segment(fs, info.path)
            if (segment := self._known[info.path]) is not None:
                found[segment.partition].append(segment)
        return {p: sorted(own, key=lambda s: s.first) for p, own in found.items()}

    @staticmethod
    def _segment(fs: pafs.FileSystem, path: str) -> Segment | None:
        meta = pq.ParquetFile(fs.open_input_file(path)).metadata
        if not meta.num_rows:
            return None
        at = meta.schema.names.index("offset")
        firsts = [meta.row_group(i).column(at).statistics.min for i in range(meta.num_row_groups)]
        partition = int(unquote(posixpath.basename(posixpath.dirname(path))).removeprefix("partition="))
        return Segment(partition, min(firsts), min(firsts) + meta.num_rows, path)

    def bounds(self) -> dict[int, tuple[int, int]]:
        """Per partition the first offset kept and the next to come.

        Segments count as far as they follow each other without a gap, so a reader
        does not pass a segment that is still being put in place.
        """
        return self.bounds_of(self.segments())

    @staticmethod
    def bounds_of(segments: dict[int, list[Segment]]) -> dict[int, tuple[int, int]]:
        out = {}
        for p, own in segments.items():
            first = end = own[0].first if own else 0
            for segment in own:
                if segment.first != end:
                    break
                end = segment.end
            out[p] = (first, end)
        return out

    def read(self, partition: int, first: int, end: int, segments: Sequence[Segment] | None = None) -> Iterator[pa.RecordBatch]:
        """Columns key, value, offset, timestamp of the messages with offsets [first, end).

        ``segments`` are those they lie in; without them the topic is listed. Row
        groups without any of the offsets are not read.
        """
        fs, _ = _file_system(self.path)
        expected = first
        for segment in self.segments()[partition] if segments is None else segments:
            if segment.end <= first or segment.first >= end:
                continue
            try:
                f = fs.open_input_file(segment.path)
            except FileNotFoundError:  # gone since it was listed
                continue
            with f:
                file = pq.ParquetFile(f)
                groups = self._groups(file.metadata, first, end)
                for batch in file.iter_batches(row_groups=groups, columns=["key", "value", "offset", "timestamp"]):
                    offsets = batch.column("offset").to_numpy()
                    batch = batch.filter(pa.array((offsets >= first) & (offsets < end)))
                    expected += batch.num_rows
                    if batch.num_rows:
                        yield batch
        if expected != end:
            raise DataLoss(f"partition {partition} of {self.path} holds {expected - first} of the {end - first} messages from {first}")


    @staticmethod
    def _groups(meta: pq.FileMetaData, first: int, end: int) -> list[int]:
        at = meta.schema.names.index("offset")
        own = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        return [i for i, s in enumerate(own) if s.max >= first and s.min < end]


def _offsets(text: str, bounds: dict[int, tuple[int, int]]) -> dict[str, int]:
    """``earliest``, ``latest`` or a JSON object of offsets (-2 earliest, -1 latest) per partition."""
    if text in ("earliest", "latest"):
        return {str(p): b[text == "latest"] for p, b in bounds.items()}
    given = json.loads(text)
    if sorted(given) != sorted(map(str, bounds)):
        raise ValueError(f"offsets {text} must name the partitions {sorted(bounds)}")
    return {p: {-2: bounds[int(p)][0], -1: bounds[int(p)][1]}.get(o, o) for p, o in given.items()}


class _TopicReading:
    """What the table and the stream reader share."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("the topic's folder is missing: load(path)")
        self.path = options["path"]
        self.topic = options.get("topic", posixpath.basename(self.path.rstrip("/")))
        self.rows_per_task = int(options.get("rowsPerTask", ROWS_PER_TASK))
        self.strict = str(options.get("failOnDataLoss", "true")).lower() == "true"
        self.log = TopicLog(self.path)

    def ranges(self, start: dict, end: dict) -> list[OffsetRange]:
        """Ranges of at most ``rows_per_task`` messages; one that is gone from the log is refused or skipped.

        A range ends with a segment if it can, so that few segments are read by two tasks.
        """
        out, segments = [], self.log.segments()
        kept = self.log.bounds_of(segments)
        for p in sorted(end, key=int):
            first, last = start.get(p, 0), end[p]
            if first < last and first < kept[int(p)][0]:
                if self.strict:
                    raise DataLoss(f"offsets {first} to {kept[int(p)][0]} of partition {p} of {self.path} are gone")
                first = min(kept[int(p)][0], last)
            own = segments[int(p)]
            firsts, ends = [s.first for s in own], [s.end for s in own]
            while first < last:
                upto = min(first + self.rows_per_task, last)
                whole = bisect_right(ends, upto)  # so many segments end by then
                if upto < last and whole and ends[whole - 1] > first:
                    upto = ends[whole - 1]
                held = own[bisect_right(ends, first) : bisect_left(firsts, upto)]
                out.append(OffsetRange(int(p), first, upto, tuple(held)))
                first = upto
        return out

    def rows(self, part: OffsetRange) -> Iterator[pa.RecordBatch]:
        for batch in self.log.read(part.partition, part.first, part.end, part.segments):
            n = batch.num_rows
            stamp = batch.column("timestamp").cast(pa.timestamp("us", tz="UTC"))
            columns = [batch.column("key"), batch.column("value"), pa.array([self.topic] * n, pa.string())]
            columns += [pa.array([part.partition] * n, pa.int32()), batch.column("offset"), stamp]
            yield pa.RecordBatch.from_arrays(columns, ["key", "value", "topic", "partition", "offset", "timestamp"])


class TopicTableReader(DataSourceReader):
    def __init__(self, options):
        self.reading = _TopicReading(options)
        bounds = self.reading.log.bounds()
        self.start = _offsets(options.get("startingOffsets", "earliest"), bounds)
        self.end = _offsets(options.get("endingOffsets", "latest"), bounds)

    def partitions(self) -> Sequence[InputPartition]:
        return self.reading.ranges(self.start, self.end) or [OffsetRange(0, 0, 0)]

    def read(self, partition: OffsetRange) -> Iterator[pa.RecordBatch]:
        return self.reading.rows(partition)


class TopicStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.reading = _TopicReading(options)
        self.starting = options.get("startingOffsets", "latest")
        self.most = int(options["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in options else None
        self.planned: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return _offsets(self.starting, self.reading.log.bounds())

    def latestOffset(self) -> dict:
        end = {str(p): b[1] for p, b in self.reading.log.bounds().items()}
        if self.most is None or self.planned is None:
            return end
        # A batch after the first takes an even share of the limit from every partition that has messages waiting.
        waiting = [p for p in end if end[p] > self.planned.get(p, 0)]
        share = max(1, self.most // max(1, len(waiting)))
        return {p: min(end[p], self.planned.get(p, 0) + share) if p in waiting else end[p] for p in end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.planned = end
        return self.reading.ranges(start, end)

    def read(self, partition: OffsetRange) -> Iterator[pa.RecordBatch]:
        return self.reading.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to tell the log: the checkpoint keeps the offsets."""


class TopicFolder(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("topic_folder").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TopicTableReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TopicStreamReader(self.options)


def create_topic(spark: SparkSession, path: str, partitions: int) -> None:
    """Make an empty topic. The number of partitions stays."""
    if partitions < 1:
        raise ValueError(f"a topic has one partition at least, not {partitions}")
    fs, root = _file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(posixpath.join(root, "_topic.json")) as f:
        f.write(json.dumps({"partitions": partitions}).encode())


def append_to_topic(df: DataFrame, path: str, key: str | None = None, value: str = "value", timestamp: str | None = None) -> None:
    """Append messages: the partition from a hash of the key (else of the value), offsets after the last one.

    Messages of a partition are ordered by timestamp, key and value. One append
    becomes segments of at most ROWS_PER_TASK messages per partition, written by
    one task per partition, as a log needs it. There may be one writer at a time.
    """
    log = TopicLog(path)
    ends = {p: b[1] for p, b in log.bounds().items()}
    names = {"key": F.col(key).cast("binary") if key else F.lit(None).cast("binary"), "value": F.col(value).cast("binary")}
    names["timestamp"] = F.col(timestamp).cast("timestamp") if timestamp else F.current_timestamp()
    messages = df.select(*[c.alias(n) for n, c in names.items()])
    messages = messages.withColumn("partition", F.pmod(F.xxhash64(F.coalesce("key", "value")), F.lit(len(ends))).cast("int"))
    order = Window.partitionBy("partition").orderBy("timestamp", "key", "value")
    base = F.element_at(F.array(*[F.lit(ends[p]).cast("bigint") for p in range(len(ends))]), F.col("partition") + 1)
    numbered = messages.withColumn("offset", base + F.row_number().over(order) - 1)
    numbered.write.mode("append").option("maxRecordsPerFile", ROWS_PER_TASK).partitionBy("partition").parquet(path)


def register_topics(spark: SparkSession) -> None:
    spark.dataSource.register(TopicFolder)


def read_topic(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The messages of a topic as a table."""
    register_topics(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def read_stream_topic(
    spark: SparkSession,
    path: str,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """Message stream of a topic, with the same options and columns as ``read_stream_kafka``."""
    register_topics(spark)
    reader = spark.readStream.format(FORMAT).option("startingOffsets", starting_offsets)
    reader = reader.option("failOnDataLoss", str(fail_on_data_loss).lower())
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return reader.load(path)
