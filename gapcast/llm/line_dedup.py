"""Remove lines that repeat across documents, with levelled sorted runs of line hashes.

DataFrame functions only. The store of lines seen so far is a handful of sorted
runs: tables bucketed and sorted by a 128-bit hash of the line. A new batch of
lines is anti-joined with each run by a merge join that reads the runs as they
lie, without a shuffle; what is left is new and becomes a run of its own. When a
level holds ``fanout`` runs they are compacted into one run of the next level,
so a batch meets a number of runs that grows with the logarithm of the batches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapcast.llm.tables import lower_ascii, partitions, stage
from gapcast.scratch import shared_dir

BLANK = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
# Ids that the cuts between batches are taken from, where ids are no numbers.
SAMPLED_IDS = 2_000


def line_key(line: Column) -> Column:
    """What two equal lines share: blanks stripped at both ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(BLANK)))


@dataclass
class LineRuns:
    """Levelled sorted runs. Keys of different runs never overlap.

    ``buckets`` files per run; every run has columns h1, h2 and ``keeper``, the
    document that the first batch with this line gave it.
    """

    spark: SparkSession
    buckets: int
    fanout: int = 3
    levels: dict[int, list[str]] = field(default_factory=dict)
    compactions: int = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in sorted(self.levels, reverse=True) for name in self.levels[level]]

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", shared_dir(self.spark, "line-run"))
            .saveAsTable(name)
        )
        self.levels.setdefault(level, []).append(name)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        names = self.levels.pop(level)
        self.compactions += 1
        self._write(reduce(DataFrame.unionByName, [self.spark.table(n) for n in names]), level + 1)
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")  # the files stay until the folder is cleaned up

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: one merge anti-join per run."""
        return reduce(lambda left, run: left.join(run.hint("merge"), KEY, "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> None:
        """Add a batch of distinct keys (h1, h2, keeper): the new ones become a run."""
        self._write(self.fresh(keys).select(*KEY, "keeper"), 0)

    def table(self) -> DataFrame:
        """All keys with their keepers."""
        return reduce(DataFrame.unionByName, self.runs())

    def drop(self) -> None:
        for names in self.levels.values():
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels.clear()


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns(
        {"row_hash": F.xxhash64("text"), "lines": F.split("text", "\n", -1)}
    )


def _keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bounds: list) -> DataFrame:
    """One row per line long enough: document, place, hashes, batch (from the largest ids down)."""
    placed = _lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col).select(
        "doc", "row_hash", F.posexplode("lines").alias("place", "line")
    )
    keyed = placed.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("doc") <= F.lit(bound)).cast("int")
    return keyed.select(
        "doc",
        "row_hash",
        "place",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        batch.alias("batch"),
    )


def _bounds(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids that cut the documents into batches of about the same size."""
    if isinstance(docs.schema[id_col].dataType, T.NumericType):
        shares = [i / batches for i in range(batches - 1, 0, -1)]
        return docs.agg(F.percentile_approx(id_col, shares, 10_000)).first()[0] or []
    # Texts and dates have no percentiles: those of the ids with the least hashes stand for all.
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLED_IDS)
    some = sorted(r["id"] for r in ids.collect())
    return [some[len(some) * i // batches] for i in range(batches - 1, 0, -1)] if some else []


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """(doc, row_hash, place): every line to drop.

    Documents come in ``batches`` of falling ids, so the first batch that holds a
    line holds its largest document, the one that keeps it. A batch's lines that
    the runs already hold only add to the count of their key.
    """
    spark = docs.sparkSession
    bounds = _bounds(docs, id_col, batches)
    lines = _keyed_lines(docs, id_col, text_col, min_chars, sorted(set(bounds), reverse=True))
    path = shared_dir(spark, "line-keys")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    store = LineRuns(spark, partitions(spark), fanout)
    tallies = []
    for batch in range(len(set(bounds)) + 1):
        own = lines.where(F.col("batch") == batch)
        tally = own.groupBy(*KEY).agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper"))
        tally = stage(tally, "line-tally")
        tallies.append(tally.select(*KEY, "n"))
        store.add(tally)
    counts = reduce(DataFrame.unionByName, tallies).groupBy(*KEY).agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= min_docs).join(store.table().hint("merge"), KEY)
    frequent = stage(frequent.select(*KEY, "keeper"), "frequent-lines")
    store.drop()
    # Both sides are read from files: a line that a third of all documents hold is split by adaptive execution.
    return lines.join(frequent, KEY).where(F.col("doc") != F.col("keeper")).select("doc", "row_hash", "place")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The documents with ``text_col`` cleaned, and columns n_lines and n_dropped.

    A line is dropped where its key has at least ``min_chars`` code points, occurs
    in at least ``min_docs`` documents, and the document is not the one with the
    largest id that holds it; that one keeps all its copies. Other columns stay,
    but for older ones named n_lines and n_dropped, which are replaced.

    Ids may be of any type that has an order. Null or empty text is one empty line and becomes the empty text. Rows without
    an id count as no document and keep all lines. Repeated rows of one id are one
    document; each keeps or loses the same lines. An empty table gives an empty
    table.
    """
    gone = repeated_lines(docs, id_col, text_col, **rules)
    gone = gone.groupBy("doc", "row_hash").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    left = docs.select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(*rest).alias("rest"),
    ).withColumn("row_hash", F.xxhash64("text"))
    joined = left.join(gone, ["doc", "row_hash"], "left").withColumns(
        {"lines": F.split("text", "\n", -1), "gone": F.coalesce("gone", F.array().cast("array<int>"))}
    )
    # The lines between two dropped ones form a slice: linear in the lines, however many are dropped.
    slices = F.zip_with(
        F.concat(F.array(F.lit(-1)), "gone"),
        F.concat("gone", F.array(F.size("lines"))),
        lambda a, b: F.slice("lines", a + 2, b - a - 1),
    )
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(slices), "\n"))
    made = joined.select(
        "rest",
        kept.alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )
    return made.select(*[F.col(f"rest.{c}").alias(c) for c in rest], F.col("kept").alias(text_col), "n_lines", "n_dropped")
