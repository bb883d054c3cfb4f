import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns that clash with names used inside, from (doc_id, text) pairs."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(list(rows), schema)
        return df.withColumns({c: F.lit("mine") for c in ("doc", "id", "node", "rest", "lines", "gone", "row_hash", "score", "place")})

    return make
