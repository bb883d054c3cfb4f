"""The driver contract: registered queries against their SQL, on the smallest tables."""

import inspect
import re

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"

# Rows only: no SQL can give their values. Three of them have a query of their properties with SQL beside them.
WITHOUT_SQL = {
    "quartiles_approximate",
    "sample_fraction",
    "random_split_counts",
    "forest_bootstrap",
    "feature_importance_gbt",
    "cv_random_forest",
    "gap_report",
}
# Also run by their own, longer tests.
SLOW = {"gap_report", "stream_score_by_label", "cv_random_forest", "forest_bootstrap", "feature_importance_gbt"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql_or_a_reason():
    own = set(entry._own_queries())
    assert set(entry.oracle_sql()) & own == own - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(set(entry._own_queries()) - SLOW))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in WITHOUT_SQL:
        assert df.count() > 0
    else:
        assert compare(df, con, entry.oracle_sql()[name]) == []


def test_comparison_notices_differences(spark, con):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert compare(df, con, "SELECT CAST(1 AS INTEGER) AS x, 'a' AS y") == []
    assert compare(df, con, "SELECT CAST(1 AS INTEGER) AS x, 'b' AS y")
    assert compare(df, con, "SELECT CAST(1 AS BIGINT) AS x, 'a' AS y")
    assert compare(df, con, "SELECT CAST(1 AS INTEGER) AS x, 'a' AS z")
    assert compare(df, con, "SELECT CAST(1 AS INTEGER) AS x, 'a' AS y FROM range(2)")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "value", "imputed"]
    assert df.filter("value IS NULL").count() == 0 and df.count() == 1000


def test_no_driver_collects_of_rows():
    """Registered queries return frames; none of them collects rows itself."""
    source = inspect.getsource(entry)
    assert not re.search(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\(", source)
