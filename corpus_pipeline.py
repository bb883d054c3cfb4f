"""The corpus pipeline: documents through quality filter, line dedup, near dedup, decontamination and packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept.
Its result is written as Parquet and read again as the docs of the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.llm import line_dedup, packing, quality, simhash, winnowing
from gapcast.llm.tables import held_out, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY = 0.7


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least QUALITY; the classifier learns from the labelled ones among them."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit_quality(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    scored = quality.score_quality(docs.select(*COLUMNS), model, score_col="quality_score")
    return scored.where(F.col("quality_score") >= QUALITY).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more of them share, but for the last that holds each."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of SimHash near duplicates (three words, two bits).

    Rows without an id stay only where no document of their group has one.
    """
    return simhash.one_of_each_group(docs.select(*COLUMNS), radius=2, size=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of any benchmark item."""
    return winnowing.clean_documents(docs.select(*COLUMNS), _read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, length=4096)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]
# A trained classifier and a tokenizer have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
