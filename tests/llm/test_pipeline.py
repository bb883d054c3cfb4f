import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from gapcast.llm import sql
from oracle_check import compare, duck
from test_line_dedup import plain as plain_lines
from test_packing import check_packing
from test_simhash import components, plain_print
from test_winnowing import plain as plain_leaks

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(sql.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF_DIR), duck(SF_DIR), sql.oracle_sql()[name]) == []


def test_stages(spark):
    """Every stage against a plain version of it, on all that the one before kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts, stages = {}, dict(pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name in list(stages)[:-1]:
        docs = pipeline.stage(stages[name](spark, docs, SF_DIR), name)
        assert docs.columns == pipeline.COLUMNS
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = texts["quality_filter"]
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)
    assert all(before[i] == t for i, t in kept.items())

    assert sorted(texts["line_dedup"].items()) == sorted((i, t) for i, t, _, _ in plain_lines(list(kept.items())))

    prints = {i: plain_print(t) for i, t in texts["line_dedup"].items()}
    groups = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert set(texts["near_duplicates"]) == set(groups.values())

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in plain_leaks(list(texts["near_duplicates"].items()), items) if hit == 0}
    assert set(texts["decontamination"]) == clean

    rows = stages["packing"](spark, docs, SF_DIR).collect()
    check_packing(list(texts["decontamination"].items()), rows, 4096)


def test_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, None, 3)], schema)
    for docs, pieces in ((odd, None), (odd.limit(0), 0)):
        for _, step in pipeline.STAGES:
            docs = pipeline.stage(step(spark, docs, SF_DIR), "odd")
        assert docs.count() == pieces if pieces is not None else docs.count() >= 0
